"""The registered queries of the training-data operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, common, conversation_repair, decontaminate, exact_dedup, lm_score, packing, passages, periodic_runs, sanitise, simhash, suffix_dedup, toxicity, url_filter

# The rules (action, host, path) of op6.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
# Conversation -7 of op7.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, common.fold("doc_id") != 0)
    return toxicity.score(docs, model).select("doc_id", (common.fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.query(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn int, role string, text string")
    formatted = chat_format.format_conversations(rows.unionByName(probe.select(*(probe[c].cast(rows.schema[c].dataType) for c in rows.columns))))
    return chat_format.digests(formatted)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.fuzzy_passages(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digests(sanitise.Sanitiser(table(spark, sf_dir, "documents")).spans())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(conversation_repair.repair(damaged, "lost"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), planted=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_simhash, op3_lm_score, op4_decontaminate, op5_exact_dedup, op6_url_filter, op7_chat_format, op8_passages, op9_suffix_dedup, op10_packing, op11_pii, op12_conversation_repair, op13_periodic_runs)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PUNCTUATION = "'" + sanitise.PUNCTUATION.replace("'", "''") + "'"

ORACLE: dict[str, str] = {
    "op4_decontaminate": rf"""
        WITH t AS (SELECT doc_id AS id, text, 0 AS kind FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark),
        w AS (SELECT id, kind, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
        d AS (SELECT id AS doc_id, ws FROM w WHERE kind = 0),
        i AS (SELECT id AS item_id, ws AS iw, len(ws) AS n, least(5, len(ws)) AS k FROM w WHERE kind = 1 AND len(ws) > 0),
        ir AS (SELECT item_id, n, k, r - 1 AS q, list_slice(iw, r, r + k - 1) AS run FROM i, unnest(range(1, n - k + 2)) AS u(r)),
        dr AS (SELECT doc_id, k, r - 1 AS p, list_slice(ws, r, r + k - 1) AS run
               FROM d, (SELECT DISTINCT k FROM i) AS ks, unnest(range(1, len(ws) - k + 2)) AS u(r)),
        s AS (SELECT DISTINCT doc_id, item_id, p AS raw, n, k FROM dr JOIN ir USING (run, k)),
        c AS (SELECT DISTINCT doc_id, item_id, n, k, greatest(least(raw, len(ws) - n), 0) AS st FROM s JOIN d USING (doc_id)),
        wr AS (SELECT doc_id, item_id, st, n, k, list_slice(ws, st + r, st + r + k - 1) AS run, least(n, len(ws)) - k + 1 AS total
               FROM c JOIN d USING (doc_id), unnest(range(1, least(n, len(ws)) - k + 2)) AS u(r)),
        wc AS (SELECT doc_id, item_id, st, n, k, total, run, count(*) AS a FROM wr GROUP BY ALL),
        ic AS (SELECT item_id, run, count(*) AS b FROM ir GROUP BY ALL),
        v AS (SELECT doc_id, item_id, st, n, sum(least(a, b))::DOUBLE / greatest(n - k + 1, total) AS similarity
              FROM wc JOIN ic USING (item_id, run) GROUP BY doc_id, item_id, st, n, k, total)
        SELECT doc_id, item_id, similarity, CAST(st AS INTEGER) AS window_start, CAST(n AS INTEGER) AS n_words
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st) AS best FROM v WHERE similarity >= 0.8)
        WHERE best = 1""",
    "op5_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
        FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS n FROM documents)
        WINDOW w AS (PARTITION BY n)""",
    "op6_url_filter": f"""
        WITH u AS (
          SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host,
                 regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
        r(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                   ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT page_id, h || p AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
              FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT u.page_id, host, path, m.rule, coalesce(m.action, 'allow') AS verdict
        FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1""",
    "op7_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        g AS (
          SELECT conv_id, count(*) AS n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS masked,
                 string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles,
                 sum(length(text) + length(regexp_replace(text, '[^~<\[]', '', 'g')) + 4
                     + CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7
                       ELSE 4 + length(role) + length(regexp_replace(role, '[^~<\[|]', '', 'g')) END) AS formatted_chars
          FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256,
               CAST(formatted_chars AS BIGINT) AS formatted_chars,
               CASE WHEN roles = 's' THEN 'primed' WHEN regexp_full_match(roles, 's?(ua)+') THEN 'answered'
                    WHEN regexp_full_match(roles, 's?(ua)*u') THEN 'asked' ELSE 'refused' END AS state,
               regexp_full_match(roles, 's?(ua)+') AS valid FROM g""",
    "op11_pii": r"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        p(k, kind, pattern) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
                                       (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
        m AS (SELECT rid, k, kind, i, ms[i] AS m, ps[i] AS l, ps[i + 1] AS r, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d
              FROM (SELECT rid, k, kind, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS ps FROM t, p), unnest(range(1, len(ms) + 1)) AS u(i)),
        o AS (SELECT *, (sum(length(l) + length(m)) OVER (PARTITION BY rid, k ORDER BY i) - length(m))::BIGINT AS s FROM m),
        e AS (SELECT rid, k, kind, l, r, s, s + length(m) AS e, kind || ':' || CASE kind WHEN 'email' THEN {m} WHEN 'ip' THEN m ELSE d END AS entity
              FROM o WHERE CASE kind WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR right(x, 3)::INTEGER > 255)) = 0
                WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(d)), lambda i:
                  CASE WHEN i % 2 = 0 THEN substr(d, (length(d) - i)::INTEGER, 1)::INTEGER
                       ELSE (2 * substr(d, (length(d) - i)::INTEGER, 1)::INTEGER) // 10 + (2 * substr(d, (length(d) - i)::INTEGER, 1)::INTEGER) % 10 END)) % 10 = 0
                WHEN 'phone' THEN length(d) BETWEEN 8 AND 15 ELSE true END),
        side AS (SELECT rid, k, s, entity, 0 AS after, right(l, 200) AS part, s - least(length(l), 200) AS base, length(l) <= 200 AS short FROM e
                 UNION ALL SELECT rid, k, s, entity, 1, left(r, 200), e, length(r) <= 200 FROM e),
        w AS (SELECT rid, k, s, entity, after, ws[i] AS w, i, base, short, length(part) AS n,
                     (base + sum(length(ws[i]) + 1) OVER (PARTITION BY rid, k, s, after ORDER BY i) - length(ws[i]) - 1)::BIGINT AS pos
              FROM (SELECT *, string_split_regex(part, '[\x20\x09-\x0D]') AS ws FROM side), unnest(range(1, len(ws) + 1)) AS u(i)),
        near AS (SELECT rid, entity, {t} AS term, pos + length(w) - length(ltrim(w, {p})) AS a, pos + length(w) - length(ltrim(w, {p})) + length(trim(w, {p})) AS b
                 FROM (SELECT * FROM w WHERE w <> '' AND (short OR CASE after WHEN 0 THEN pos > base ELSE pos + length(w) < base + 200 END)
                       QUALIFY row_number() OVER (PARTITION BY rid, k, s, after ORDER BY CASE after WHEN 0 THEN -pos ELSE pos END) <= 8)
                 WHERE trim(w, {p}) <> '' AND NOT regexp_matches(trim(w, {p}), '[0-9@+]')),
        pairs AS (SELECT entity, term, count(DISTINCT text) AS f_both FROM near JOIN t USING (rid) GROUP BY ALL HAVING count(DISTINCT text) >= 3),
        wide AS (SELECT entity, left(term, 4) AS form, count(DISTINCT text) AS f_wide FROM near JOIN t USING (rid) GROUP BY ALL),
        own AS (SELECT entity, count(DISTINCT text) AS f_own FROM e JOIN t USING (rid) GROUP BY ALL),
        words AS (SELECT text, {u} AS term FROM (SELECT DISTINCT text FROM t WHERE EXISTS (FROM pairs)), unnest(string_split_regex(text, '[\x20\x09-\x0D]')) AS u(w) WHERE trim(w, {p}) <> ''),
        f1 AS (SELECT term, count(DISTINCT text) AS f_term FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY ALL),
        f2 AS (SELECT left(term, 4) AS form, count(DISTINCT text) AS f_form FROM words WHERE left(term, 4) IN (SELECT left(term, 4) FROM pairs) GROUP BY ALL),
        told AS (SELECT entity, term, CASE WHEN ln(n * f_wide / (f_form * f_own)) / ln(n / f_own) >= 0.95 THEN 1 ELSE 0 END AS removed
                 FROM pairs JOIN own USING (entity) JOIN f1 USING (term) JOIN wide ON wide.entity = pairs.entity AND wide.form = left(pairs.term, 4) JOIN f2 ON f2.form = wide.form,
                      (SELECT count(DISTINCT text)::DOUBLE AS n FROM t)
                 WHERE f_own < n AND ln(n * f_both / (f_term * f_own)) / ln(n / f_own) >= 0.95),
        terms AS (SELECT rid, a, b, max(removed) AS removed FROM near JOIN told USING (entity, term) GROUP BY ALL),
        spans AS (SELECT rid, k, s AS a, kind || ':' || s || ':' || e AS span FROM e UNION ALL SELECT rid, 4, a, 'term:' || a || ':' || b FROM terms),
        listed AS (SELECT rid, string_agg(span, ',' ORDER BY k, a) FILTER (k < 4) AS base, string_agg(span, ',' ORDER BY k, a) AS spans,
                          count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone
                   FROM spans GROUP BY rid),
        acts AS (SELECT rid, sum(removed)::BIGINT AS n_removed, sum(1 - removed)::BIGINT AS n_generalised FROM terms GROUP BY rid)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_generalised, 0) AS n_generalised, coalesce(n_removed, 0) AS n_removed
        FROM t LEFT JOIN listed USING (rid) LEFT JOIN acts USING (rid)""".replace("{m}", _LOWER.format("m")).replace("{t}", _LOWER.format("trim(w, {p})")).replace("{u}", _LOWER.format("trim(w, {p})")).replace("{p}", _PUNCTUATION),
    "op12_conversation_repair": r"""
        WITH RECURSIVE ids AS (
          SELECT *, CASE WHEN v IS NULL THEN ' ' ELSE v END AS key
          FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS v FROM conversations)),
        sums AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
                   lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                     lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS m
                 FROM (SELECT DISTINCT key FROM ids)),
        damaged AS (
          SELECT conv_id, turn, CASE m WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM ids JOIN sums USING (key), unnest(CASE m WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS u(copy)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                          rtrim(text, E' \t\n\x0b\x0c\r') AS said FROM damaged),
        r AS (
          SELECT *, CASE WHEN said = '' THEN 'blank'
                         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                         WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                 left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
          FROM placed),
        c AS (
          SELECT conv_id, coalesce(max(turn)::BIGINT - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
          FROM r GROUP BY conv_id),
        step(s, t, edit, cost, x, inserted) AS (
          SELECT i.s, CASE edit WHEN 'D' THEN i.t WHEN 'R' THEN CASE i.t WHEN 2 THEN 3 ELSE 2 END ELSE k.t END, repeat('I', i.k) || edit,
                 5 * i.k + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END, k.x, i.said
          FROM (VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''), (0, 1, 2, 'user:' || chr(10)), (1, 1, 2, 'user:' || chr(10)),
                       (2, 1, 3, 'assistant:' || chr(10)), (3, 1, 2, 'user:' || chr(10)), (0, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
                       (1, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 2, 'assistant:' || chr(10) || 'user:' || chr(10)),
                       (3, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10))) AS i(s, k, t, said),
               (VALUES ('D'), ('K'), ('R')) AS e(edit), (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3), (NULL, NULL, NULL)) AS k(x, f, t)
          WHERE CASE edit WHEN 'K' THEN k.f = i.t ELSE k.x IS NULL END),
        walk AS (
          SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM c
          UNION ALL
          SELECT conv_id, i, t, cost, audit, lines FROM (
            SELECT w.conv_id, w.i + 1 AS i, p.t, w.cost + p.cost + CASE WHEN r.fault = 'truncated' AND p.edit NOT LIKE '%D' THEN 5 ELSE 0 END AS cost,
                   w.audit || p.edit AS audit,
                   w.lines || p.inserted || CASE right(p.edit, 1) WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10)
                     ELSE CASE p.t WHEN 3 THEN 'assistant:' ELSE 'user:' END || r.text || chr(10) END AS lines
            FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
            JOIN step p ON p.s = w.s AND (p.x IS NULL OR p.x = r.x) AND (p.edit LIKE '%D' OR r.fault NOT IN ('blank', 'duplicate')))
          QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) = 1),
        ends AS (
          SELECT * FROM (SELECT w.conv_id, w.cost + 5 * length(e.tail) AS cost, w.audit || e.tail AS audit, w.lines || e.said AS lines
          FROM walk w JOIN c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
          JOIN (VALUES (0, '', ''), (1, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 'I', 'assistant:' || chr(10)), (3, '', '')) AS e(s, tail, said) USING (s))
          QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(left(lines, length(lines) - 1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ends ON o.conv_id IS NOT DISTINCT FROM ends.conv_id""",
}
