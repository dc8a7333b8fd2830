"""The registered queries: each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import language
from .chat import canonical_turns, format_turns, read_learned, read_turns, turn_rows_to_records
from .decontaminate import benchmark_hits
from .jaccard import jaccard_components
from .licenses import LICENSES, license_matches
from .manifest import leaf_digest, merkle_manifest
from .mixture import mix_sources
from .quality import quality_verdicts
from .repair import damaged, repair_conversations
from .sharding import shard_texts
from .storage import shared_path
from .tokencount import piece_scores, token_counts
from .tokenfile import read_token_files, write_token_files
from .toxicity import THRESHOLD, Model, toxicity_scores, train_on

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query, run with the library's settings."""

    @wraps(function)
    def tuned(spark: SparkSession, folder: str) -> DataFrame:
        return function(tune(spark), folder)

    QUERIES[function.__name__] = tuned
    return tuned


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in verbatim matches of benchmark items."""
    found = benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.col("hit_spans.n")), F.lit(0)).alias("longest_stretch"),
    )


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers; the folder can be given in WARDLINE_TOKENIZERS."""
    folder = os.environ.get("WARDLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the pieces and scores of a public vocabulary."""
    return token_counts(table(spark, folder, "documents"), piece_scores(tokenizer_file("piece_bpe_32k.model")))


SHARDS = 16


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    sharded = shard_texts(docs, SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in all documents."""
    notices = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in LICENSES])
    templates = spark.range(1).select(F.explode(notices).alias("t")).select("t.*")
    return license_matches(table(spark, folder, "documents"), templates)


ORACLES["op4_license_scan"] = r"""
WITH notices AS (SELECT * FROM (VALUES NOTICES) AS v(template, text)),
split AS (SELECT template, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM notices),
sized AS (SELECT template, w, greatest(16, CAST(pow(2, ceil(log2(len(w))) + 1) AS BIGINT)) AS width FROM split),
parts AS (SELECT DISTINCT template, width, array_to_string(w[i:i+4], ' ') AS g FROM sized, range(1, len(w) - 3) AS r(i)),
totals AS (SELECT template, COUNT(*) AS n_shingles FROM parts GROUP BY template),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
shingles AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS g FROM words, range(1, len(w) - 3) AS r(i)),
hits AS (SELECT doc_id, pos, g, template, width, width // 2 AS step FROM shingles JOIN parts USING (g)),
windows AS (
  SELECT doc_id, template, width, k, COUNT(DISTINCT g) AS matched
  FROM hits, range(greatest(0, CAST(floor((pos + 5 - width + step - 1) / step) AS BIGINT)), pos // step + 1) AS r(k) GROUP BY ALL)
SELECT doc_id, template, n_shingles, MAX(matched) AS most_matched, COUNT(*) AS n_windows, MIN(k * width // 2) AS first_word
FROM windows JOIN totals USING (template) WHERE matched * 100 >= n_shingles * 80 GROUP BY doc_id, template, n_shingles
""".replace("NOTICES", ", ".join(f"('{n}', '{t}')" for n, t in LICENSES))


@query
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every document under links of five-word shingle similarity 0.8."""
    return jaccard_components(table(spark, folder, "documents"))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of all documents by limits that follow their language and source."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return quality_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLES["op6_quality_rules"] = r"""
WITH split AS (
  SELECT doc_id, lang, source, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i+2] AS g FROM split, range(1, len(w) - 1) AS r(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY COUNT(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, COUNT(DISTINCT i + o) AS n FROM twice, range(0, 3) AS r(o) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM split),
stats AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '\p{Lu}')) AS n_capitals,
    len(l) - len(list_distinct(l)) AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words
  FROM split JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM stats),
ruled AS (
  SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'capitals', 'lines', 'repeats', 'length']) AS rule,
    unnest([n_symbols * 1000 // greatest(word_chars, 1), n_capitals * 1000 // greatest(word_chars, 1), n_dup_lines * 1000 // greatest(n_words, 1),
      n_repeat_words * 1000 // greatest(n_words, 1), word_chars * 100 // greatest(n_words, 1)]) AS v
  FROM based),
sketched AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS r FROM ruled WHERE NOT base_failed),
ranked AS (
  SELECT *, COUNT(*) OVER own AS n_own, ROW_NUMBER() OVER (PARTITION BY lang, source, rule ORDER BY r) AS k_own,
    COUNT(*) OVER (PARTITION BY lang, rule) AS n_lang, ROW_NUMBER() OVER (PARTITION BY lang, rule ORDER BY r) AS k_lang,
    COUNT(*) OVER (PARTITION BY rule) AS n_all, ROW_NUMBER() OVER (PARTITION BY rule ORDER BY r) AS k_all
  FROM sketched WINDOW own AS (PARTITION BY lang, source, rule)),
own AS (SELECT lang, source, rule, MAX(n_own) AS n, MIN(r) FILTER (k_own >= ceil(n_own * 0.25)) AS a, MIN(r) FILTER (k_own >= ceil(n_own * 0.5)) AS b,
  MIN(r) FILTER (k_own >= ceil(n_own * 0.75)) AS c FROM ranked GROUP BY ALL),
langs AS (SELECT lang, rule, MAX(n_lang) AS n, MIN(r) FILTER (k_lang >= ceil(n_lang * 0.25)) AS a, MIN(r) FILTER (k_lang >= ceil(n_lang * 0.5)) AS b,
  MIN(r) FILTER (k_lang >= ceil(n_lang * 0.75)) AS c FROM ranked GROUP BY ALL),
everything AS (SELECT rule, MIN(r) FILTER (k_all >= ceil(n_all * 0.25)) AS a, MIN(r) FILTER (k_all >= ceil(n_all * 0.5)) AS b,
  MIN(r) FILTER (k_all >= ceil(n_all * 0.75)) AS c FROM ranked GROUP BY ALL),
mixed AS (
  SELECT l.lang, l.rule, (l.n * l.a + 10 * e.a) // (l.n + 10) AS a, (l.n * l.b + 10 * e.b) // (l.n + 10) AS b, (l.n * l.c + 10 * e.c) // (l.n + 10) AS c
  FROM langs l JOIN everything e USING (rule)),
chosen AS (
  SELECT o.lang, o.source, o.rule, (o.n * o.a + 10 * m.a) // (o.n + 10) AS a, (o.n * o.b + 10 * m.b) // (o.n + 10) AS b, (o.n * o.c + 10 * m.c) // (o.n + 10) AS c
  FROM own o JOIN mixed m USING (lang, rule)),
broken AS (
  SELECT doc_id, BOOL_OR(v > greatest(c + (c - b) * 6, b + CASE rule WHEN 'symbols' THEN 40 WHEN 'capitals' THEN 200 WHEN 'lines' THEN 50 WHEN 'repeats' THEN 450 ELSE 150 END)
    OR (rule = 'length' AND v < least(a - (b - a) * 6, b - 150))) AS bad
  FROM ruled LEFT JOIN chosen USING (lang, source, rule) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT COALESCE(bad, false) AS kept
FROM based JOIN broken USING (doc_id)
"""


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    return train_on(docs, labels.filter(~held_out(F.col("doc_id"))))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, folder, "documents")
    model = toxicity_model(docs, table(spark, folder, "labels"))
    scored = toxicity_scores(docs, model, carry=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """One pass worth of bytes with sources weighted by the square root of their size."""
    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "n_chars", "copy", "shuffle_key")


ORACLES["op8_mixture"] = """
WITH sized AS (
  SELECT source, CAST(SUM(strlen(COALESCE(text, '')) + 1) AS DOUBLE) AS bytes FROM documents GROUP BY source),
rated AS (
  SELECT source, sqrt(bytes) / (SELECT SUM(sqrt(bytes)) FROM sized) * (SELECT SUM(bytes) FROM sized) / bytes AS rate FROM sized),
parted AS (
  SELECT source, CAST(greatest(ceil(rate / 32), 1) AS BIGINT) AS parts, rate / greatest(ceil(rate / 32), 1) AS each FROM rated),
terms AS (
  SELECT source, parts, k, SUM(exp(-each + k * ln(each) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM parted, range(0, CAST(ceil(each + sqrt(each) * 12 + 24) AS BIGINT) + 1) AS r(k)),
draws AS (
  SELECT d.doc_id, d.source, d.n_chars, p.part, ('0x' || md5('11:' || d.doc_id || ':' || p.part)[1:15])::BIGINT / 1152921504606846976.0 AS u
  FROM documents d JOIN parted USING (source), range(1, parts + 1) AS p(part)),
counted AS (
  SELECT doc_id, source, n_chars, part, (SELECT COUNT(*) FROM terms t WHERE t.source = draws.source AND t.upto <= u) AS n FROM draws),
repeated AS (SELECT doc_id, source, n_chars, SUM(n) AS n FROM counted GROUP BY ALL)
SELECT doc_id, source, n_chars, copy, ('0x' || md5('11:' || doc_id || ':' || copy || ':order')[1:15])::BIGINT AS shuffle_key
FROM repeated, range(1, CAST(n AS BIGINT) + 1) AS c(copy)
"""


END_ID = 2


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written to packed files and read back."""
    from tokenizers import Tokenizer

    name = tokenizer_file("word_bpe_49k.json")
    with open(name, encoding="utf-8") as file:
        text = file.read()
    size = Tokenizer.from_str(text).get_vocab_size()
    files = write_token_files(table(spark, folder, "documents"), shared_path(spark, "tokens"), text, size, END_ID)
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, and what reading them back gives."""
    text = "</s>[INST] ok [/INST]"
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    formatted = format_turns(canonical_turns(turn_rows_to_records(rows), "record"))
    back = formatted.select(
        "conv_id", "layout", "formatted",
        read_turns(F.col("formatted")).alias("back"),
        F.array_join(read_learned(F.col("formatted"), F.col("loss_spans")), "").alias("learned"),
    )
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


ORACLES["op10_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, 12 + length(url_encode(role)) + 1 + 11
    + length(regexp_replace(regexp_replace(text, '(<)(\\*(?:\||/?s>|</?SYS>>))', '\1#\2', 'g'), '(\[)(\\*/?INST\])', '\1#\2', 'g')) AS chars
  FROM turns)
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  SUM(chars)::BIGINT AS formatted_chars,
  CASE string_agg(role, ',' ORDER BY turn, role, text) WHEN 'user,assistant' THEN 'prompt_response'
    WHEN 'system,user,assistant' THEN 'instruction' ELSE 'messages' END AS layout
FROM marked GROUP BY conv_id
"""


def unseen(doc_id: Column) -> Column:
    """Rows whose languages are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@query
def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train_on(docs.filter(~unseen(F.col("doc_id"))))
    found = language.languages_of(docs, model, carry=["doc_id"])
    return found.select("doc_id", unseen(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query
def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after some of their rows were damaged."""
    rows = damaged(table(spark, folder, "conversations"))
    return repair_conversations(rows, live=F.col("live"))


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query
def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The Merkle manifest of all documents, and which of them still verify after some texts were tampered with."""
    docs = table(spark, folder, "documents")
    record = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.translate(F.col("text"), CAPITALS, CAPITALS.lower())
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle_manifest(
        docs, "doc_id", "lang", leaf_digest(*record, F.col("text")), F.when(hit, leaf_digest(*record, tampered))
    )


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs for the trees over ``leaves`` (tree, key, digest): places, nodes of all levels, runs of children, heights."""
    return f"""
{name}_p AS (SELECT tree, key, digest, ROW_NUMBER() OVER (PARTITION BY tree ORDER BY key NULLS FIRST, digest) - 1 AS place FROM {leaves}),
{name}_n(tree, level, place, digest) AS (
  SELECT tree, 0, place, digest FROM {name}_p
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY tree) AS n FROM {name}_n) WHERE n > 1 GROUP BY tree, level, place // 8),
{name}_r AS (SELECT tree, level, place // 8 AS up, list(digest ORDER BY place) AS run FROM {name}_n GROUP BY ALL),
{name}_h AS (SELECT tree, level, digest FROM {name}_n QUALIFY level = MAX(level) OVER (PARTITION BY tree))"""


def _fold_sql(name: str, start: str) -> str:
    """CTE ``name_f``: rows of ``start`` (id, tree, place, was, claim, proof) folded to the top of their tree."""
    return f"""
{name}_s(id, tree, level, place, claim, proof) AS (
  SELECT id, tree, 0, place, claim, proof FROM {start}
  UNION ALL
  SELECT s.id, s.tree, s.level + 1, s.place // 8,
    sha256(array_to_string(run[:s.place % 8], '') || s.claim || array_to_string(run[s.place % 8 + 2:], '')),
    proof || array_to_string(run[:s.place % 8], '') || array_to_string(run[s.place % 8 + 2:], '')
  FROM {name}_s s JOIN {name}_h h ON h.tree = s.tree JOIN {name}_r r ON r.tree = s.tree AND r.level = s.level AND r.up = s.place // 8
  WHERE s.level < h.level),
{name}_f AS (SELECT s.id, s.tree, s.claim, s.proof, h.digest FROM {name}_s s JOIN {name}_h h ON h.tree = s.tree AND h.level = s.level)"""


def _leaf_sql(text: str) -> str:
    fields = [f"COALESCE(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


ORACLES["op13_manifest"] = f"""
WITH RECURSIVE bytes(i, step, v) AS (
  SELECT i, 0, i FROM range(256) AS r(i) UNION ALL
  SELECT i, step + 1, xor(v >> 1, (v & 1) * 3988292384) FROM bytes WHERE step < 8),
crcs AS (SELECT list(v ORDER BY i) AS t FROM bytes WHERE step = 8),
hashed AS (
  SELECT doc_id, COALESCE('v' || lang, '') AS tree, ROW_NUMBER() OVER () AS id, {_leaf_sql("text")} AS leaf,
    {_leaf_sql(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")} AS other,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda h, c: xor(h >> 8, t[xor(h & 255, c) + 1]), 4294967295::BIGINT), 4294967295) % 3 = 0 AS hit
  FROM documents, crcs),
a_leaves AS (SELECT tree, struct_pack(d := doc_id, l := leaf, i := id) AS key, leaf AS digest FROM hashed),{_tree_sql("a", "a_leaves")},
b_leaves AS (SELECT 0 AS tree, tree AS key, digest FROM a_h),{_tree_sql("b", "b_leaves")},
a_start AS (SELECT id, p.tree, p.place, CASE WHEN hit THEN other ELSE leaf END AS claim, '' AS proof FROM a_p p JOIN hashed ON p.key.i = id),{_fold_sql("a", "a_start")},
b_start AS (SELECT id, 0 AS tree, place, claim, proof FROM a_f JOIN b_p ON b_p.key = a_f.tree),{_fold_sql("b", "b_start")}
SELECT doc_id, leaf, a_f.digest AS subroot, b_f.digest AS root, sha256(b_f.proof) AS proof_sha256, b_f.claim AS folded_root,
  b_f.claim = b_f.digest AS verified
FROM hashed JOIN a_f USING (id) JOIN b_f USING (id)
"""
