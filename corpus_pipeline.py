"""A corpus pipeline over ``documents``: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``docs``. Other columns than those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm import exact, langid, mixing, packing, simhash
from tidewater.llm.common import discard, documents, fold_remainder, materialise
from tidewater.llm.queries import tokenizer_path

#: A document is rejected if no language is as likely as this, or if it has no letter.
LEAST_LANGUAGE_SCORE = 0.5


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that ``docs`` does not have."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        found.append(name)
    return found


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter (null and empty texts too), or with no likely language, go.

    Languages are learnt from the rows of four folds out of five that have a label. Repeated rows share one fate. An
    empty table stays empty. Of all columns only the text leaves the engine.
    """
    (found,) = _free(docs, "found")
    languages, matrix = langid.train(docs.where(fold_remainder("doc_id", 5) != 0))
    out = docs.withColumn(found, langid.classifier(spark, languages, matrix)(F.col("text").cast("string")))
    return out.where((F.col(found)["language"] != langid.UNKNOWN) & (F.col(found)["score"] >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; rows that repeat both id and text become one.

    Null counts as empty, and a null id as smaller than any other.
    """
    (digest,) = _free(docs, "digest")
    found = materialise(exact.exact_dedup(docs), "exact")
    gone = found.where("not kept").select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    rows = exact.with_digest(docs, digest)
    kept = rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (rows[digest] == gone["gone_digest"]), "left_anti")
    if found.where("kept and keep_rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", digest])
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. An id goes only if all of its rows do.

    Texts without a word (null and empty too) are near-duplicates of each other. A null id is larger than any other.
    """
    found = simhash.near_duplicates(docs)
    ids = found.groupBy(F.col("id").alias("gone_id")).agg(F.bool_or(F.col("id").eqNullSafe(F.col("component"))).alias("stays"))
    gone = ids.where("not stays").select("gone_id")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never.

    Null and empty texts have no words and are taken like others of their source. Rows alike in id, source and size are
    told apart by their texts, so that reruns agree. An empty table stays empty.
    """
    doc, of, size, place, copy = _free(docs, "doc", "of", "size", "place", "copy")
    same = ("mix_id", "mix_source", "mix_size")
    out = materialise(mixing.mix(docs), "mix").select(F.col("id").alias(same[0]), F.col("source").alias(same[1]), F.col("size").alias(same[2]), F.col("times").alias("mix_times"))
    rows = docs.withColumns({doc: F.col("doc_id").cast("long"), of: F.col("source").cast("string"), size: mixing.words_in(F.col("text").cast("string"))})
    alike = out.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if alike:
        out = out.withColumn("mix_place", F.row_number().over(Window.partitionBy(*same).orderBy("mix_times")))
        text = F.col("text").cast("string")
        rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(doc, of, size).orderBy(F.xxhash64(text), text)))
    out = out.where("mix_times > 0")
    match = rows[doc].eqNullSafe(out[same[0]]) & rows[of].eqNullSafe(out[same[1]]) & (rows[size] == out[same[2]])
    taken = rows.join(out, match & (rows[place] == out["mix_place"]) if alike else match)
    repeated = taken.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), out["mix_times"])).alias(copy))
    return repeated.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place.

    Null and empty texts are one piece that holds the end of document alone; each row of a repeated id is packed on its own.
    """
    out = packing.pack(docs, tokenizer_path())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Language models, fingerprints and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialise(stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
