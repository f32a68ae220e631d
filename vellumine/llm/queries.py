"""The thin queries ``opN_<name>`` over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import chat, decontaminate, infill, langmix, licences, mixing, nearcopy, packing, shards, spelling, tiff, tokens, toxicity
from vellumine.session import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF file of pages in three codecs and read back, with digests of what was read.

    Null and empty texts are a page of bytes 255; a row for each row, so repeated ids repeat; equal texts have equal values.
    """
    rows = tiff.stored_digests(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_min_max_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are similar by 85 percent.

    Null, empty and white-space texts have no shingles and are components of their own, as are rows without an id; rows
    that repeat an id have a row each, with one component. The smallest id of a component is kept; there are no ties.
    """
    return nearcopy.near_duplicates(_documents(spark, sf_dir), size=3, percent=85)


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text, learnt from labels outside the held-out fifth.

    Null and empty texts score alike, equal texts equally, repeated rows have a row each. A null id is not held out. Null labels
    and labels without a document are ignored; where nothing can be learnt the score is the share of toxic labels.
    """
    documents = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(documents, labels.where(_remainder(5) != 0))
    rows = toxicity.with_toxicity(documents, model)
    return rows.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text. Null and empty texts have none; repeated rows have a row each."""
    rows = tokens.with_token_counts(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from an event log, rendered, and read back from the rendered form.

    Null texts are empty, null roles too; turns that tie go by role and text; repeated rows are turns of their own, and a null
    conversation is one conversation.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    read = chat.read_back(chat.render(chat.fold_events(chat.events_of_rows(rows.unionByName(probe)))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, and each whole line of them, against the known digests; per row the licences found. Null texts: no digest, no lines."""
    return licences.scanned(_documents(spark, sf_dir).select("doc_id", "text"), licences.known_digests(spark))


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null and empty texts hold none, null item ids are not listed, repeated rows have a row each."""
    return decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the documents outside the held-out quarter.

    Null texts and those without a letter are ``und`` with score 0; of equally likely languages the first by name is taken; rows
    without a language teach nothing; repeated rows have a row each. A null id is not held out.
    """
    documents = _documents(spark, sf_dir)
    model = langmix.fit(documents.where(_remainder(4) != 2))
    rows = langmix.with_language(documents.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of nearly equal bytes; equal texts, null and empty ones as one, share a shard. Repeated rows have a slot each."""
    rows = shards.with_shards(_documents(spark, sf_dir).select("doc_id", "text"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in a mix of all sources by their bytes to the power 0.9. Null is a source; null and repeated ids are rows like others."""
    return mixing.mix(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in three at random code points and put together anew, with digests of the result and of the text rebuilt from it.

    Null and empty texts are plain, as are texts that hold a mark; repeated rows have a row each, with equal values. A null id draws as
    an empty one.
    """
    rows = infill.with_infill(_documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = digest(infill.restored(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), back.alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, one run of 31 of them misspelt, with the frequent form that each belongs to. Null and empty texts have no words; repeated rows count again."""
    runs = spelling.letter_runs(spread(_documents(spark, sf_dir).select("doc_id", "text")), least=7)  # shorter ones give no word
    return spelling.variant_forms(spelling.vocabulary(spelling.misspelt(runs, one_in=31)))


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as token ids, cut into pieces that fill sequences of 4096. Null and empty texts are their end id alone; repeated rows are packed each."""
    return packing.packed(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_tiff_pages,
        op2_min_max_near_copies,
        op3_toxicity,
        op4_token_counts,
        op5_event_chat,
        op6_license_digests,
        op7_suffix_arrays,
        op8_language_mixtures,
        op9_minimax_shards,
        op10_pfair_mix,
        op11_fill_in_middle,
        op12_spelling_variants,
        op13_harmonic_packing,
    )
} | {"pipeline": corpus_pipeline.run}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    form = f"regexp_replace(lower({text}), {_sql_text(licences.COPYRIGHT_LINE)}, ' ', 'g')"
    form = f"(' ' || regexp_replace({form}, {_sql_text(licences.NO_WORD)}, '  ', 'g') || ' ')"
    form = "replace({}, '{}', '{}')".format(form, *licences.STEM)
    for spelled, spelling in licences.SPELLINGS:
        form = f"replace({form}, ' {spelled.replace(' ', '  ')} ', ' {spelling.replace(' ', '  ')} ')"
    return f"trim({form})"


#: CRC-32 in SQL: its table from the polynomial, and a fold over the bytes of a list.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || list_transform(range(8), lambda k: 0), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"


def _crc_sql(byte_list: str, table: str = "t") -> str:
    return f"xor(list_reduce([4294967295] || {byte_list}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


_KNOWN_SQL = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, texts in licences.KNOWN.items() for text in texts)
_WHOLE_SQL = ", ".join(f"({_sql_text(name)}, {_sql_text(digest)})" for name, digest in licences.whole_digests())
_WORDS7 = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL: dict[str, str] = {
    "op2_min_max_near_copies": r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= 85 * (x.n + y.n - met.n)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON ends.a = reach.r),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r AS component_id, d.doc_id = r AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op5_event_chat": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role), '')) AS loss_sha256,
  CAST(sum(length(role) + length(esc) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_license_digests": f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT license, sha256({_canonical_sql("text")}) AS digest FROM (VALUES {_KNOWN_SQL}) AS k(license, text) UNION ALL FROM (VALUES {_WHOLE_SQL}) AS w(license, digest)) GROUP BY 1),
whole AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS names
  FROM (SELECT doc_id, sha256({_canonical_sql("line")}) AS digest FROM lines WHERE trim(line) <> '') JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license AS document_license, coalesce(n, 0) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN found f ON f.doc_id = w.doc_id""",
    "op7_suffix_arrays": f"""
WITH dw AS (SELECT doc_id, {_WORDS7.format("text")} AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS7.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (size, key)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS s FROM d),
formed AS (
  SELECT doc_id, t, n, least(a, b) AS lo, greatest(a, b) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts""",
    "op12_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
coded AS (SELECT run, k, list_transform(string_split(doc_id || ':' || run, ''), lambda c: unicode(c)) AS points FROM each),
hashed AS (SELECT run, k, {_crc_sql("flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))")} AS h FROM coded, crc),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
met AS (
  SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM holes a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word FROM holes a JOIN v b ON a.rest = b.word),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY y.n DESC, b) AS best, max(y.n) AS best_n FROM met JOIN v y ON y.word = b GROUP BY a),
formed AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT w.word, w.next, f.form FROM walk w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL""",
}
