"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspine.llm import chat, divergence, licenses, line_dedup, merkle, mixing, nn_descent, packed_ids, packing, quality, simhash, toxicity, winnowing
from statspine.llm.common import held_out, ship, table
from statspine.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(fn):
    """Register ``fn`` under its name; tasks get the package's files before it runs."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.scored(docs, grammar), toxicity.THRESHOLD)


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), RANKS, PATTERN)
    return packing.best_fit(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


SQL["op3_line_dedup"] = r"""
    WITH line AS (
        SELECT doc_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS value
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
    ), word AS (
        SELECT doc_id, n, list_filter(string_split_regex(lower(value), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS w FROM line
    ), tokens AS (
        SELECT doc_id, n, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS t
        FROM word WHERE len(w) > 0
    ), each AS (SELECT doc_id, n, len(t) AS size, unnest(t) AS token FROM tokens
    ), gone AS (
        SELECT DISTINCT doc_id, n FROM (
            SELECT b.doc_id, b.n FROM each a JOIN each b
            ON a.token = b.token AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.n < b.n)
            GROUP BY a.doc_id, a.n, b.doc_id, b.n
            HAVING count(*) * 1800 >= (any_value(a.size) + any_value(b.size)) * 800)
    )
    SELECT line.doc_id, coalesce(string_agg(value, chr(10) ORDER BY line.n) FILTER (gone.n IS NULL), '') AS text,
        count(*)::INT AS n_lines, count(gone.n)::INT AS n_removed
    FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.n = gone.n GROUP BY line.doc_id
"""


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fp_text(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.scored(docs, model), quality.THRESHOLD)


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.sql("SELECT -7L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role), '</s>[INST] ok [/INST]' AS text")
    shown = chat.formatted(rows.unionByName(hostile))
    loss = F.array_join(chat.loss_texts(F.col("formatted"), F.col("mask")), "")
    read = shown.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat.parse(F.col("formatted")).alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


SQL["op6_chat_formatting"] = r"""
    WITH said AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        (8 + sum(17 + length(role) + length(text) + len(regexp_extract_all(text, '</?s>|\[/?INST\]'))))::BIGINT AS formatted_chars
    FROM said GROUP BY conv_id
"""


@query
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(table(spark, sf_dir, "documents"))


@query
def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "_mix.pass", "_mix.block", "_mix.weight", "_mix.tokens", "_mix.place")


@query
def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL["op9_nn_descent"] = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    ), link AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
    ), reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept
    FROM v JOIN reach ON a = vec_id GROUP BY vec_id
"""


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    of_phrase = F.create_map(*(F.lit(x) for pair in licenses.PHRASES.items() for x in pair))
    base = F.array_distinct(F.transform("places", lambda p: F.element_at(of_phrase, p.phrase)))
    met = F.concat("blocks", "passages")
    own = F.transform(met, lambda b: b.label)
    starts = F.transform("places", lambda p: p.start)
    best = F.coalesce(F.array_max(F.transform(met, lambda b: b.containment)), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = r"""
    WITH doc AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    ), word AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc
    ), kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= 30
    ), many AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
    ), grp AS (SELECT DISTINCT lang, source FROM doc
    ), own AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY lang, source, term
    ), cell AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM grp JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)
    ), p AS (
        SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
            1 + 1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
        FROM cell JOIN many USING (lang)
    ), far AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
        WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source
    ), every AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM every QUALIFY part = 'pair' OR rank <= 50
"""


@query
def op12_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "packed-ids")
    encode = partial(packing.token_ids, ranks=RANKS, pattern=PATTERN)
    packed_ids.write(table(spark, sf_dir, "documents"), path, encode, packed_ids.vocabulary(JSON), close=2)
    return packed_ids.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def manifest_rows(docs: DataFrame) -> DataFrame:
    """Digests, proof and the check of every document; where 7 divides the crc32 of its id, the row is tampered with."""
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = F.when(touched, F.unhex(merkle.tampered_leaf()))
    leaves = docs.select("lang", "doc_id", F.unhex(merkle.leaf()).alias("digest"), changed.alias("changed"))
    found = merkle.manifest(leaves).withColumn("leaf", merkle.shown(F.col("digest")))
    folded = merkle.fold(F.coalesce(merkle.shown(F.col("changed")), F.col("leaf")), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_rows(table(spark, sf_dir, "documents"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"


_LEAF = "sha256(" + " || ".join(map(_field, merkle.FIELDS)) + ")"
SQL["op13_merkle_manifest"] = f"""
    WITH RECURSIVE known AS (
        SELECT doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace(_field("n_chars"), _field("n_chars + 1"))} AS other,
            xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte:
                list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, byte)), 4294967295)) % 7 = 0 AS touched
        FROM documents
    ), doc AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS r FROM known
    ), tree AS (
        SELECT lang, 0 AS level, list(leaf ORDER BY r) AS h FROM doc GROUP BY lang
        UNION ALL SELECT lang, level + 1, list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], ''))) FROM tree WHERE len(h) > 1
    ), subroots AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM tree WHERE len(h) = 1
    ), top AS (
        SELECT 1000 AS level, list(subroot ORDER BY r) AS h FROM subroots
        UNION ALL SELECT level + 1, list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], ''))) FROM top WHERE len(h) > 1
    ), steps AS (
        SELECT doc_id, doc.lang, doc.r, level, (doc.r >> level) % 2 AS side, h[xor(doc.r >> level, 1) + 1] AS sibling
        FROM doc JOIN tree ON doc.lang IS NOT DISTINCT FROM tree.lang AND len(h) > 1
        UNION ALL SELECT doc_id, doc.lang, doc.r, level, (s.r >> (level - 1000)) % 2, h[xor(s.r >> (level - 1000), 1) + 1]
        FROM doc JOIN subroots s ON doc.lang IS NOT DISTINCT FROM s.lang CROSS JOIN top WHERE len(h) > 1
    ), path AS (
        SELECT lang, r, string_agg(sibling, '' ORDER BY level) AS proof,
            list(CASE WHEN sibling IS NULL THEN 'N' WHEN side = 1 THEN 'L' || sibling ELSE 'R' || sibling END ORDER BY level) AS steps
        FROM steps GROUP BY lang, r
    ), folded AS (
        SELECT doc_id, leaf, subroot, (SELECT h[1] FROM top WHERE len(h) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
            list_reduce(coalesce(steps, []), lambda node, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || node WHEN 'R' THEN node || s[2:] ELSE node END),
                CASE WHEN touched THEN other ELSE leaf END) AS folded_root
        FROM doc JOIN subroots ON doc.lang IS NOT DISTINCT FROM subroots.lang LEFT JOIN path ON path.lang IS NOT DISTINCT FROM doc.lang AND path.r = doc.r
    )
    SELECT *, folded_root = root AS verified FROM folded
"""
