"""Applications and resume versions as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import cleaning
from rankloom.operators import ml, skills
from rankloom.operators.matching import chunk_lists, chunk_maxsim
from rankloom.session import dealt, written
from rankloom.streaming.runs import MERGED, Runs, newest


def rescore_on_apply(
    applications: DataFrame,
    job_vectors: DataFrame,
    resume_vectors: DataFrame,
    path: str,
    checkpoint: str,
):
    """Score new applications as they arrive.

    A score depends on its own application only, so the earlier ones need no
    second look. A repeated batch overwrites its own folder.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        scored = chunk_maxsim(dealt(batch), job_vectors, resume_vectors)
        scored.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        applications.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(score)
        .start()
    )


def latest_versions(versions: DataFrame, key: str, order: Column) -> DataFrame:
    """The newest version per key; versions merge map-side."""
    return (
        versions.groupBy(key)
        .agg(F.max_by(F.struct(*versions.columns), order).alias("_row"))
        .select("_row.*")
    )


def prepared(versions: DataFrame, phrases: DataFrame, model, encoder=ml.hashed_encoder) -> DataFrame:
    """What the arrival of a version sets off: its text (``doc_id``, ``text``) cleaned,
    cut into chunks with a vector each (``vectors``), classified by the vector of the
    whole text (``category``) and searched for skills (``skills``). A text without a
    word has no vectors and no skills."""
    clean = versions.withColumn("text", cleaning.clean_text(F.col("text")))
    clean = written(clean, "clean-versions")  # read by each of the following
    chunks = clean.select("doc_id", F.posexplode(cleaning.chunk_words(F.col("text"))).alias("chunk_no", "chunk"))
    lists = chunk_lists(ml.embed(chunks, "chunk", "vector", encoder).select("doc_id", "chunk_no", "vector"))
    whole = ml.category_classify(ml.embed(clean, "text", "vector", encoder), model).select("doc_id", "category")
    return (
        clean.join(lists, "doc_id", "left")
        .join(whole, "doc_id", "left")
        .join(skills.skill_pool(clean, phrases), "doc_id", "left")
    )


#: Columns of a prepared resume beside its owner and version (``doc_id``).
PREPARED = "text string, vectors array<array<float>>, category string, skills array<string>"


def resumes(path: str, owner: str = "string", merged: int = MERGED) -> Runs:
    """The newest prepared version of each owner's resume."""
    schema = f"owner {owner}, doc_id bigint, {PREPARED}, part int"
    return Runs(f"{path}/resumes", schema, newest("owner", "doc_id"), "part", merged)


def resume_update_stream(
    versions: DataFrame, phrases: DataFrame, model, path: str, checkpoint: str,
    encoder=ml.hashed_encoder, parts: int = 16, merged: int = MERGED,
):
    """Prepare resumes as their versions (``owner``, ``doc_id`` rising by version,
    ``text``) arrive, in any order, and repeatedly.

    A batch takes each owner's newest version, leaves out those not newer than what
    is stored, and prepares and writes the rest as a run. Of what is stored it reads
    owners and versions only, and only in the parts (of owners, by hash) that it touches.
    A repeated batch overwrites its run; merged runs keep the newest versions.
    """
    table = resumes(path, versions.schema["owner"].dataType.simpleString(), merged)

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = latest_versions(batch.select("owner", "doc_id", "text"), "owner", F.col("doc_id"))
        latest = latest.withColumn("part", F.pmod(F.xxhash64("owner"), F.lit(parts)).cast("int"))
        touched = [r.part for r in latest.select("part").distinct().collect()]  # at most ``parts``
        stored = table.before(spark, batch_id).where(F.col("part").isin(touched)) if touched else table.before(spark, batch_id)
        known = stored.groupBy("owner").agg(F.max("doc_id").alias("_known"))
        newer = latest.join(known, "owner", "left").where("_known is null or doc_id > _known")
        ready = prepared(newer.select("owner", "doc_id", "text", "part"), phrases, model, encoder)
        table.write(ready.select("owner", "doc_id", "text", "vectors", "category", "skills", "part"), batch_id)
        table.tidy(spark, batch_id)

    return (
        versions.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(update)
        .start()
    )
