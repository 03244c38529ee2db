"""Stateful streaming: sessions across turns, restoration of fragmented texts, event framing."""
