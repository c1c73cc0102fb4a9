"""The queries of the operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontaminate, embedding_dedup, fill_in_middle, language_id, lm_scoring, mixing, piece_codec, secret_scan, simhash, token_output, url_filter
from .common import table

TOKENIZER = "byte_bpe_50k.json"


PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select(F.col("id").alias("doc_id"), language_id.held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "accepted")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_rows(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -1L conv_id, turn, role, '{said}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(turn, role)")
    return chat_format.digest_rows(chat_format.format_chats(rows.unionByName(own)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "confidence")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_output.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path(PIECES)
    found = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.restore(fill_in_middle.transform(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damage(rows))
    return conversation_repair.digest_rows(found, rows.select(F.col("conv_id").cast("long").alias("conv"))).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_mix_sources, op4_secret_scan, op5_chat_format, op6_url_filter, op7_simhash, op8_embedding_dedup, op9_lm_score, op10_token_output, op11_piece_codec, op12_fill_in_middle, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": OP3, "op4_secret_scan": OP4, "op5_chat_format": OP5, "op6_url_filter": OP6, "op8_embedding_dedup": OP8, "op12_fill_in_middle": OP12, "op13_conversation_repair": OP13}


#: Targets by the level at which all sources that aren't capped stand; copies in proportion to size, then in the order of the
#: random odds over the inclusion odds.
OP3 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS most, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, coalesce(max(CASE WHEN level * w <= most THEN level END) OVER () * w, most)) AS target FROM l),
h AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
g AS (SELECT h.source, size, (target - 2.0::DOUBLE * coalesce(sum(size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(size * size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, arg_max(rate, size) AS rate FROM g WHERE rate * size <= 2 GROUP BY source),
e AS (SELECT d.doc_id, d.source, d.size, d.text, t.source_size, t.target, CASE WHEN size = 0 THEN 0 ELSE coalesce(least(2.0::DOUBLE, rate * size), 2.0::DOUBLE) END AS due
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
u AS (SELECT *, floor(due) AS whole, due - floor(due) AS p, target - sum(floor(due) * size) OVER (PARTITION BY source) AS rest,
    (('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, md5(text), '3')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM e),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM u),
a AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p > 0 AND rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM a
"""


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    found = f"regexp_extract_all(t, '{p}')"
    value = f"regexp_extract_all(t, '{p}', {group})"
    # offsets: each match is looked for behind the one before, in what is left of the text
    return f"""SELECT doc_id, repo, owner, k, '{kind}' AS kind, s.start AS start, s.start + length(s.m) AS "end", s.v AS value FROM (
      SELECT doc_id, repo, owner, k, unnest(list_transform(range(1, len(f) + 1), lambda i: struct_pack(m := f[i], v := v[i], start := length(array_to_string(list_transform(range(1, i + 1), lambda j: g[j] || CASE WHEN j < i THEN f[j] ELSE '' END), ''))))) AS s
      FROM (SELECT doc_id, repo, owner, k, {found} AS f, {value} AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))) WHERE length(s.v) >= {least}"""


_TOKEN = "[A-Za-z0-9+/_=-]{20,}"
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, md5(coalesce(text, '')) AS repo, coalesce(source, chr(1)) AS owner, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_sql_spans(k, p, g, n) for k, (p, g, n) in secret_scan.BASE.items())}),
tok AS (SELECT x.* FROM ({_sql_spans("owned", _TOKEN, 0, 20)}) x WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = x.k AND b.start < x."end" AND x.start < b."end")),
every AS (SELECT * FROM base UNION ALL SELECT * FROM tok),
owned AS (SELECT owner, count(DISTINCT repo) AS n FROM d GROUP BY owner),
held AS (SELECT value, count(*) AS n_owners, sum(repos) AS n_repos, sum(n) AS n_all FROM (SELECT value, owner, count(DISTINCT repo) AS repos FROM every GROUP BY ALL) JOIN owned USING (owner) GROUP BY value),
judged AS (SELECT e.*, h.n_owners <= {secret_scan.MAX_OWNERS} AND h.n_repos <= greatest({secret_scan.MAX_REPOS}, {secret_scan.MAX_SHARE}::DOUBLE * h.n_all) AS live, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END AS r,
    kind || ':' || start || ':' || "end" AS said FROM every e JOIN held h USING (value)),
g AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY start, r) FILTER (kind <> 'owned') AS base, string_agg(said, ',' ORDER BY start, r) FILTER (kind <> 'owned' OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND kind <> 'owned') AS n_example FROM judged GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (k)
"""


def _sql_escape(text: str) -> str:
    t = chat_format.Template()
    text = f"replace({text}, '\\', '\\\\')"
    for c in t.controls():
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return text


_t = chat_format.Template()
_ends = {r: len(b) + len(a) + len(_t.turn_end) for r, (b, a, _) in _t.roles.items()}
_other = sum(map(len, _t.other)) + len(_t.turn_end)
_moves = " OR ".join(f"(was = '{a}' AND role IN ({', '.join(repr(b) for b in bs)}))" for a, bs in _t.moves.items())
OP5 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, n, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, role)),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') AS was, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM c),
e AS (SELECT *, length({_sql_escape("text")}) + CASE role {" ".join(f"WHEN '{r}' THEN {n}" for r, n in _ends.items())} ELSE length({_sql_escape("role")}) + {_other} END AS chars, ({_moves}) AS ok FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars, bool_and(ok) AND bool_or(back = 1 AND role IN ({", ".join(repr(x) for x in _t.final)})) AS valid
FROM e GROUP BY conv_id
"""

_Z2, _RULES = url_filter.Z**2, url_filter.RULES
_fits = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in _RULES)
_named = ", ".join(f"'{x}'" for x in url_filter.named_by(_RULES))
#: Association rules by listing every set of tokens of every decided url.
OP6 = rf"""
WITH o AS (SELECT page_id, url, translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host0,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path0 FROM pages),
a AS (SELECT page_id, url, coalesce(host0, '') AS host, coalesce(path0, '') AS path FROM o),
d AS (SELECT DISTINCT url, host, path FROM a),
f AS (SELECT d.url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS listed FROM d JOIN ({_fits}) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY d.url),
t AS (SELECT d.*, f.rule, f.listed, list_distinct(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' WHEN length(x) > 64 THEN '~' || sha256(x) ELSE x END) ||
    list_transform(list_filter(string_split_regex(path, '[/.]'), lambda x: x <> ''), lambda x: 'p:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' WHEN length(x) > 64 THEN '~' || sha256(x) ELSE x END) ||
    list_transform(list_filter(regexp_extract_all(regexp_extract(coalesce(url, ''), '(?s)\?([^#]*)', 1), '([^&=]+)(=[^&]*)?', 1), lambda x: x <> ''), lambda x: 'q:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' WHEN length(x) > 64 THEN '~' || sha256(x) ELSE x END)) AS tokens
    FROM d LEFT JOIN f USING (url)),
b AS (SELECT url, listed, list_sort(list_filter(tokens, lambda x: x NOT IN ({_named}))) AS tokens FROM t WHERE listed IS NOT NULL),
c AS (SELECT * FROM b WHERE len(tokens) > 0),
m AS (SELECT count(*) AS total FROM c),
y AS (SELECT listed AS verdict, count(*)::DOUBLE / (SELECT total FROM m) AS share FROM c GROUP BY ALL),
s AS (SELECT listed, list_filter(tokens, lambda x, i: (k // (2 ** (i - 1))::BIGINT) % 2 = 1) AS items FROM (SELECT *, unnest(range(1, (2 ** len(tokens))::BIGINT)) AS k FROM c)),
n AS (SELECT items, count(*) AS n FROM s GROUP BY ALL),
r0 AS (SELECT s.items, s.listed AS verdict, count(*) AS both_, any_value(n.n) AS n FROM s JOIN n USING (items) GROUP BY ALL),
r1 AS (SELECT items, verdict, both_ / n::DOUBLE AS confidence, n, both_ FROM r0 WHERE both_ >= greatest({url_filter.LEAST}, {url_filter.SUPPORT} * (SELECT total FROM m)) - 0.5),
r2 AS (SELECT r1.*, (confidence + {_Z2} / (2 * n) - {url_filter.Z} * sqrt((confidence * (1 - confidence) + {_Z2} / (4 * n)) / n)) / (1 + {_Z2} / n) AS bound FROM r1),
r3 AS (SELECT r2.* FROM r2 JOIN y USING (verdict) WHERE bound >= {url_filter.CONFIDENCE} AND bound >= {url_filter.LIFT} * share),
r AS (SELECT * FROM r3 x WHERE NOT EXISTS (SELECT 1 FROM r3 z WHERE z.verdict = x.verdict AND len(z.items) < len(x.items) AND list_has_all(x.items, z.items) AND z.confidence >= x.confidence)),
w AS (SELECT url, max(struct_pack(confidence := confidence, both_ := both_, verdict := verdict)) AS best FROM t JOIN r ON t.listed IS NULL AND list_has_all(t.tokens, r.items) GROUP BY url)
SELECT page_id, a.host, a.path, t.rule, coalesce(t.listed, w.best.verdict, 'allow') AS verdict, CASE WHEN t.listed IS NULL THEN w.best.confidence END AS confidence
FROM a JOIN t ON t.url IS NOT DISTINCT FROM a.url LEFT JOIN w ON w.url = a.url
"""

#: Each pair once, in double precision; components by a recursive union.
OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT *, row_number() OVER () AS r FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y, a.vec_id AS ia, b.vec_id AS ib FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
walk(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.vec_id, l.ib FROM walk w JOIN l ON l.ia = w.seen),
n AS (SELECT ia AS vec_id, count(*) AS n FROM l GROUP BY ia)
SELECT w.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(seen) AS component_id, w.vec_id = min(seen) AS kept FROM walk w LEFT JOIN n ON n.vec_id = w.vec_id GROUP BY w.vec_id
"""

#: Lines as a list; cuts are slices of it.
OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

_ADD = "struct_pack(c := s[{0}].c + {1}, a := s[{0}].a || '{2}')"


def _sql_least(*ways: tuple[int, int, str]) -> str:
    """The least (cost, audit) over states, costs and edits."""
    return "list_min([" + ", ".join(_ADD.format(i, cost, said) for i, cost, said in ways) + "])"


def _sql_step() -> str:
    """States after one more turn ``f`` from closed states ``s``: delete, rerole to user or assistant, keep."""
    extra = "CASE f.fault WHEN 't' THEN 5 ELSE 0 END"
    keep = lambda c, i: f"CASE WHEN f.fault IN ('', 't') AND f.initial = '{c}' THEN {_ADD.format(i, extra, 'K')} END"  # noqa: E731
    rerole = lambda i: f"CASE WHEN f.fault IN ('', 't') THEN {_ADD.format(i, '1 + ' + extra, 'R')} END"  # noqa: E731
    drop = lambda i: _ADD.format(i, 2, "D")  # noqa: E731
    states = [[drop(1)], [drop(2), keep("s", 1)], [drop(3), *(w(i) for i in (1, 2, 4) for w in (rerole, lambda i: keep("u", i)))], [drop(4), rerole(3), keep("a", 3)]]
    return "[" + ", ".join(f"list_min([{', '.join(ways)}])" for ways in states) + "]"


_closed = ("[s[1], s[2], " + _sql_least((3, 0, ""), (1, 5, "I"), (2, 5, "I"), (4, 5, "I")) + ", " + _sql_least((4, 0, ""), (3, 5, "I"), (1, 10, "II"), (2, 10, "II")) + "]")
_crc = ("list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(k, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), "
        "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))")
#: One turn of every conversation at a time, with the least (cost, audit) of each of four states.
OP13 = rf"""
WITH RECURSIVE q AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_crc}, 4294967295::BIGINT) % 20 AS d FROM q),
dam AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE d <> 0),
o AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM dam),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, [struct_pack(c := 0::BIGINT, a := ''), NULL, NULL, NULL] AS s FROM f
    UNION ALL SELECT conv_id, i, {_sql_step()} FROM (SELECT w.conv_id, f.i, {_closed} AS s, f FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
last AS (SELECT conv_id, list_min([{_ADD.format(1, 0, "")}, {_sql_least((4, 0, ""), (3, 5, "I"), (1, 10, "II"), (2, 10, "II"))}]) AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM walk) WHERE back = 1),
p AS (SELECT conv_id, e, unnest(range(1, length(e.a) + 1)) AS p FROM last),
x AS (SELECT conv_id, p, e.a[p] AS edit, count(*) FILTER (e.a[p] <> 'I') OVER w AS i, count(*) FILTER (e.a[p] <> 'D') OVER w AS nth FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
y AS (SELECT x.*, f.role, f.text, bool_or(edit = 'K' AND nth = 1 AND initial = 's') OVER (PARTITION BY x.conv_id) AS sys FROM x LEFT JOIN f ON x.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i WHERE edit <> 'D'),
z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - 1 - sys::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said FROM y GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM every LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM every.conv_id
"""
