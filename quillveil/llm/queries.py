"""The registered queries of this subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from . import ctw, decontam, filters, langid, neardup, order, packing, repair, repetition, replies, secrets, simhash, toxicity

QUERIES = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_language_id": langid.op2_language_id,
    "op3_training_order": order.op3_training_order,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": repetition.op5_quality_rules,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lm_score": ctw.op8_lm_score,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_chat_format": replies.op10_chat_format,
    "op11_simhash": simhash.op11_simhash,
    "op12_filter_audit": filters.op12_filter_audit,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

#: The template's control strings in a text, with the backslashes before them doubled and one more.
_ESCAPED = r"regexp_replace({0}, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\])', '\1\1\\\2', 'g')"
_LINES = """(select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, n, case n when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) t(n))"""

SQL: dict[str, str] = {
    "op10_chat_format": f"""select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
      sum(1 + length({_ESCAPED.format("text")}) + case role when 'user' then 15 when 'system' then 17 when 'assistant' then 9
        else 30 + length({_ESCAPED.format("role")}) end)::bigint as formatted_chars
      from {_LINES} group by conv_id""",
    "op12_filter_audit": """with d as (select coalesce(source, '') as part, doc_id, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
      marked as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
      masks as (select part, good, toxic, (case when len(w) < 200 then 1 else 0 end)
          + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
          + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end)
          + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
          + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) as mask
        from d left join marked using (doc_id)),
      c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from masks group by part, mask),
      letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
      orders as (select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e
        where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
      steps as (select o, s, 1 << (strpos('ABCDE', substr(o, s, 1)) - 1)::integer as b,
          coalesce(list_sum(list_transform(string_split(substr(o, 1, s - 1), ''), lambda y: case when y = '' then 0 else 1 << (strpos('ABCDE', y) - 1)::integer end)), 0)::integer as before
        from orders, range(1, 6) r(s))
    select part, o as filter_order, s::integer as step,
      sum(case when (mask & (before | b)) = 0 then n else 0 end)::bigint as kept,
      sum(case when (mask & b) <> 0 and (mask & before) = 0 then n else 0 end)::bigint as removed,
      sum(case when (mask & b) <> 0 and (mask & before) <> 0 then n else 0 end)::bigint as redundant,
      sum(case when mask = b then n else 0 end)::bigint as unique_fails,
      sum(case when (mask & b) <> 0 and (mask & before) = 0 then good else 0 end)::bigint as good_lost,
      sum(case when (mask & b) <> 0 and (mask & before) = 0 then toxic else 0 end)::bigint as toxic_lost,
      sum(case when (mask & b) <> 0 then n * (120 // bit_count(mask)) else 0 end)::bigint as shapley
    from c, steps group by part, o, s""",
}
