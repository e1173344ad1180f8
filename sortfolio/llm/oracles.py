"""The queries that SQL can express, for DuckDB over the driver's tables; written independently of the Spark code."""

from __future__ import annotations

from sortfolio.llm.chat import CONTROLS, END, START
from sortfolio.llm.rules import STOP_WORDS, THRESHOLDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontamination(window: int = 10) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
cut AS (SELECT item_id, w, least(len(w), {window}) AS size, unnest(range(1, CAST(len(w) - least(len(w), {window}) + 2 AS BIGINT))) AS s
        FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS t FROM cut),
places AS (SELECT r, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS s
           FROM d CROSS JOIN (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
dw AS (SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS t FROM places),
hits AS (SELECT DISTINCT dw.r, dw.s, dw.size, bw.item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.size = bw.size),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + size)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""


def quality_rules() -> str:
    measures = {
        "symbol_ratio": "n_symbols / nullif(n_words, 0)", "letter_ratio": "n_letters / nullif(word_chars, 0)",
        "upper_ratio": "n_upper / nullif(n_letters, 0)", "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "has_stop_word": "CAST(stop AS INTEGER)", "bar_ratio": "n_bars / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "bullet_line_ratio": "n_bullets / nullif(n_lines, 0)"}
    broken = []
    for name, measure, low, high in THRESHOLDS:
        value = f"coalesce({measures[measure]}, 0)"
        tests = ([f"{value} < {low}::DOUBLE"] if low is not None else []) + ([f"{value} > {high}::DOUBLE"] if high is not None else [])
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    stop = ", ".join(f"'{x}'" for w in dict.fromkeys(STOP_WORDS) for x in (w, w.capitalize()))
    only = lambda kept: rf"length(regexp_replace(t, '{kept}', '', 'g'))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM rep GROUP BY r),
m AS (SELECT w.r, doc_id, len(w) AS n_words, {only(r'[\x20\x09-\x0D]+')} AS word_chars, {only('[^#*$%&|<>]+')} AS n_symbols,
             {only('[^|]+')} AS n_bars, {only(r'\P{Lu}+')} AS n_upper, {only(r'\P{L}+')} AS n_letters, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets,
             list_has_any(w, [{stop}]) AS stop, coalesce(again.n, 0) AS n_repeat_words FROM w LEFT JOIN again USING (r)),
v AS (SELECT *, list_filter([{', '.join(broken)}], lambda x: x IS NOT NULL) AS failed,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM v"""


def chat_formatting() -> str:
    ok = "</s>[INST] ok [/INST]"

    def size(x: str) -> str:
        marks = " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS))
        return f"(length({x}) + {marks})"

    order = "ORDER BY turn, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, replace(coalesce(role, ''), chr(10), ' ') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{ok}' UNION ALL SELECT -7, 1, 'assistant', '{ok}')
SELECT conv_id, CASE WHEN conv_id = -7 THEN 'prompt' ELSE 'messages' END AS layout, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(START) + len(END) + 2} + {size('role')} + {size('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


def phrase_collocations(least: int = 10, top: int = 2000, share: int = 50) -> str:
    million = "CAST(1000000 AS HUGEINT)"
    cut = lambda l, r: f"{million} * a * a // (CAST({l} AS HUGEINT) * {r})"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS i FROM w),
f1 AS (SELECT lang, w[i] AS x, count(*) AS n FROM g GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS a FROM g WHERE i < len(w) GROUP BY ALL),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS a FROM g WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= {least}),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f1 GROUP BY lang),
inside AS (SELECT lang, x, y, max(a) AS longer FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL),
two AS (SELECT c.lang, c.x || ' ' || c.y AS phrase, c.a, l.n AS l, r.n AS r, {cut('l.n', 'r.n')} AS score
        FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
        LEFT JOIN inside i ON i.lang = c.lang AND i.x = c.x AND i.y = c.y WHERE c.a >= {least} AND 100 * coalesce(i.longer, 0) < {share} * c.a),
cuts AS (SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.a, l1.n AS l1, r1.a AS r1, l2.a AS l2, r2.n AS r2
         FROM f3 c JOIN f1 l1 ON l1.lang = c.lang AND l1.x = c.x JOIN f2 r1 ON r1.lang = c.lang AND r1.x = c.y AND r1.y = c.z
         JOIN f2 l2 ON l2.lang = c.lang AND l2.x = c.x AND l2.y = c.y JOIN f1 r2 ON r2.lang = c.lang AND r2.x = c.z),
three AS (SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r, least(s1, s2) AS score
          FROM (SELECT *, {cut('l1', 'r1')} AS s1, {cut('l2', 'r2')} AS s2 FROM cuts)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
           FROM (SELECT * FROM two UNION ALL SELECT * FROM three))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= {top}"""


def warc_round_trip() -> str:
    digit = lambda i: f"(instr('0123456789abcdef', substr(h, CAST({i} AS BIGINT) + 1, 1)) - 1)"
    # five bits of the digest from two of its hexadecimal digits
    five = f"(({digit('5 * i // 4')} * 16 + {digit('5 * i // 4 + 1')}) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS FIRST) AS place, first_value(page_id) OVER (PARTITION BY t ORDER BY page_id NULLS FIRST) AS lead FROM p)
SELECT page_id, url, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN lead END AS refers_to,
       CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({five}), 1)), '') AS payload_digest FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_round_trip": warc_round_trip(), "op8_decontamination": decontamination(), "op9_quality_rules": quality_rules(), "op10_chat_formatting": chat_formatting(),
            "op11_phrase_collocations": phrase_collocations()}
