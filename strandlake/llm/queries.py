"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, filter_audit, mixing, packing, parsing, pii, quality_rules, sharding, simhash, suffix_trees, toxicity, whitening
from .common import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=8)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.summary(chat.format_paths(chat.threads(rows.unionByName(extra))))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.digests(read_table(spark, sf_dir, "documents"))
    return exact_dedup.exact_dedup(rows, exact_dedup.half_history())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(toxicity.sample(docs, read_table(spark, sf_dir, "labels"))))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read_table(spark, sf_dir, "documents")))


def op7_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(read_table(spark, sf_dir, "documents")))


def op10_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.remove_repeats(read_table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {q.__name__: q for q in (op1_sharding, op2_chat, op3_mixing, op4_exact_dedup, op5_toxicity, op6_packing, op7_suffix_trees, op8_simhash, op9_quality_rules, op10_parsing, op11_pii, op12_whitening, op13_filter_audit)}


_WORDS = r"list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_ESC = "replace(replace(replace({}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e')"


def _mixing_sql() -> str:
    dims, m = mixing.DIMENSIONS, mixing
    many = "length(t) - length(translate(t, '{}', '')) > length(t) / {}"
    topic = f"CASE WHEN {many.format('|#*$%&', 50)} THEN 'markup' WHEN {many.format('!?', 50)} THEN 'exclaimed' WHEN {many.format('0123456789', 50)} THEN 'numeric' ELSE 'prose' END"
    steps = [
        f"r AS (SELECT doc_id, source, lang, {topic} AS topic, n_tokens FROM (SELECT doc_id, source, lang, coalesce(text,'') AS t, len({_WORDS}) AS n_tokens FROM documents))",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL)",
        "z AS (SELECT sum(tokens) AS total FROM c)",
    ]
    for d in dims:
        up = "ORDER BY held / weight, v ROWS BETWEEN"
        steps += [
            f"h_{d} AS (SELECT {d} AS v, sum(tokens) AS held, pow(sum(tokens) / any_value(total), {m.TEMPERATURE}) AS weight FROM c, z GROUP BY {d})",
            f"o_{d} AS (SELECT held / weight AS ratio, ({m.BUDGET} * total - coalesce(sum(held) OVER ({up} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({up} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY held / weight, v) AS n FROM h_{d}, z WHERE held > 0 AND weight > 0)",
            f"t_{d} AS (SELECT v, CASE WHEN held > 0 THEN least(held, weight * coalesce((SELECT arg_min(level, n) FROM o_{d} WHERE level <= ratio), 'inf'::DOUBLE)) ELSE 0 END AS t FROM h_{d})",
        ]
    targets = ", ".join(f"t_{d}.t AS t_{d}" for d in dims)
    joins = " ".join(f"JOIN t_{d} ON c.{d} IS NOT DISTINCT FROM t_{d}.v" for d in dims)
    steps.append(f"w AS (SELECT 0 AS n, source, lang, topic, tokens, {targets}, {m.BUDGET} * tokens AS raked, false AS done FROM c {joins} UNION ALL SELECT n + 1, source, lang, topic, tokens, {', '.join(f't_{d}' for d in dims)}, raked, (n + 1) % {m.ROUNDS_PER_STEP} = 0 AND (max(gap) OVER () <= {m.TOLERANCE} OR n + 1 >= {m.MOST_ROUNDS}) FROM _GAP WHERE NOT done)")
    inner = "w"
    for d in dims:
        now = f"sum(raked) OVER (PARTITION BY {d})"
        inner = f"(SELECT * REPLACE (CASE WHEN {now} > 0 THEN least(tokens, raked * t_{d} / {now}) ELSE 0 END AS raked) FROM {inner})"
    gap = f"(SELECT *, greatest({', '.join(f'CASE WHEN t_{d} > 0 THEN abs(sum(raked) OVER (PARTITION BY {d}) / t_{d} - 1) ELSE 0 END' for d in dims)}) AS gap FROM {inner})"
    steps[-1] = steps[-1].replace("_GAP", gap)
    same = " AND ".join(f"r.{d} IS NOT DISTINCT FROM w.{d}" for d in dims)
    rate = "CASE WHEN w.tokens > 0 THEN w.raked / w.tokens ELSE 1.0 END"
    u = "('0x' || substr(md5(concat(coalesce(r.doc_id::VARCHAR, ''), ':mix')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"WITH RECURSIVE {', '.join(steps)} SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens::BIGINT AS n_tokens, round({rate}, 6) AS probability, {u} < {rate} AS selected FROM r JOIN w ON {same} WHERE w.done"


def _quality_sql() -> str:
    bits = " + ".join(f"CASE WHEN {cond} THEN {quality_rules.BIT[name]} ELSE 0 END" for name, cond in quality_rules.RULES)
    mask = quality_rules.POLICIES[quality_rules.DEFAULT_POLICY].mask | quality_rules.BASE.mask
    return rf"""WITH t AS (SELECT doc_id, coalesce(text,'') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text,''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, list_slice(w, i, i + 7) AS gram FROM t, unnest(range(1, len(w) - 6)) u(i)) QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(i - p, 8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM d) GROUP BY 1),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
 len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN c ON t.doc_id = c.doc_id),
b AS (SELECT *, ({bits})::BIGINT AS failure_bits FROM m)
SELECT *, (failure_bits & {quality_rules.BASE.mask}) <> 0 AS base_failed, (failure_bits & {mask}) = 0 AS kept, '{quality_rules.DEFAULT_POLICY}' AS policy FROM b"""


def _audit_sql() -> str:
    fails = {
        "A": "len(w) < 200", "B": "100 * len(list_distinct(w)) < 50 * len(w)", "C": "100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)",
        "D": "regexp_matches(t, '[#$%&*|]')", "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)",
    }
    letters = " || ".join(f"CASE WHEN {c} THEN '{f}' ELSE '' END" for f, c in fails.items())
    orders = ", ".join(f"'{o}'" for o in filter_audit.ORDERS)
    gone = "translate(substr(o, 1, s - 1), f, '') <> substr(o, 1, s - 1)"
    hit = "contains(f, substr(o, s, 1))"
    total = lambda what, cond, name: f"coalesce(sum({what}) FILTER ({cond}), 0)::BIGINT AS {name}"
    return f"""WITH t AS (SELECT doc_id, coalesce(source,'') AS part, coalesce(text,'') AS t, {_WORDS} AS w FROM documents), m AS (SELECT doc_id, part, {letters} AS f FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
c AS (SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY part, f),
x AS (SELECT part, f, n, good, bad, o, s::INT AS s FROM c, unnest([{orders}]) a(o), unnest(range(1, 6)) b(s)),
g AS (SELECT part, o AS filter_order, s AS step, substr(o, s, 1) AS "filter", {total("n", f"NOT ({gone}) AND NOT {hit}", "kept")}, {total("n", f"NOT ({gone}) AND {hit}", "removed")}, {total("n", f"({gone}) AND {hit}", "redundant")},
 {total("n", "f = substr(o, s, 1)", "unique_fails")}, {total("good", f"NOT ({gone}) AND {hit}", "good_lost")}, {total("bad", f"NOT ({gone}) AND {hit}", "toxic_lost")} FROM x GROUP BY part, o, s)
SELECT *, (sum(removed) OVER (PARTITION BY part, "filter"))::BIGINT AS shapley FROM g"""


#: Sharding and SimHash need hashes that DuckDB lacks, toxicity, personal data and packing a trained model
#: or a tokenizer, whitening an eigenvalue solver.
ORACLE_SQL: dict[str, str] = {
    "op2_chat": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(4 + length(replace({_ESC.format("role")}, ':', '\c')) + 2 + length({_ESC.format("text")}) + 8)::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
    "op3_mixing": _mixing_sql(),
    "op4_exact_dedup": r"""WITH n AS (SELECT doc_id, length(coalesce(text,''))::BIGINT AS n_points, sha256(regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_points FROM k""",
    "op7_suffix_trees": rf"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), x AS (SELECT doc_id, i, hash(list_slice(w, i, i + 49)) AS h FROM t, unnest(range(1, len(w) - 48)) u(i)),
r AS (SELECT doc_id, i FROM x QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id), g AS (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM r), s AS (SELECT DISTINCT doc_id, p FROM g),
l AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM s GROUP BY 1), v AS (SELECT t.doc_id, p, w[p] AS word FROM t, unnest(range(1, len(w) + 1)) u(p)),
k AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.p) AS kept FROM v LEFT JOIN s ON v.doc_id = s.doc_id AND v.p = s.p WHERE s.p IS NULL GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM t LEFT JOIN l ON t.doc_id = l.doc_id LEFT JOIN k ON t.doc_id = k.doc_id""",
    "op9_quality_rules": _quality_sql(),
    "op13_filter_audit": _audit_sql(),
    "op10_parsing": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS x FROM documents),
c AS (SELECT doc_id, j * 128 AS o, substr(x, (j * 256 + 1)::BIGINT, 454) AS c FROM t, unnest(range(0, (length(x) // 2 + 127) // 128)) u(j)),
w AS (SELECT doc_id, o + i AS s, hash(substr(c, (2 * i + 1)::BIGINT, 200)) AS h FROM c, unnest(range(0, least(128, length(c) // 2 - 99))) u(i)),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
n AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS n FROM r),
g AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT doc_id, s, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM n) GROUP BY doc_id, k),
l AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM g GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS z FROM g UNION ALL SELECT doc_id, max(b), NULL FROM g GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(x, (2 * f + 1)::BIGINT, (2 * (coalesce(z, length(x)) - f))::BIGINT), '' ORDER BY f) AS kept FROM e JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(l.n_removed, 0)::BIGINT AS n_removed, coalesce(l.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.kept, x))) AS kept_sha256
 FROM t LEFT JOIN l ON t.doc_id = l.doc_id LEFT JOIN k ON t.doc_id = k.doc_id""",
}
