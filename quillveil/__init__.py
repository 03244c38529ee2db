"""quillveil: finding and pseudonymizing personal data in text on Spark."""
