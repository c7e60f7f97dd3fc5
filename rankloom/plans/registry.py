"""One query per operator, each over the whole of the tables it uses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.functions import categories as cat
from rankloom.functions import cleaning, jd_fields, vectors
from rankloom.operators import (
    activity,
    lifecycle,
    matching,
    ml,
    ranking,
    relations,
    sampling,
    scoring,
    skills,
    spans,
    text_stats,
    ticks,
)
from rankloom.plans.entities import Entities, now
from rankloom.plans.flagship import shortlist_by_match
from rankloom.session import dealt, new_table_path, settled, written
from rankloom.sources import readers, sinks
from rankloom.streaming import activity as live
from rankloom.streaming import applications as live_apps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BUZZWORDS = ("the", "that", "and", "with", "la", "der", "que")
QUESTIONS_PER_FILE = 1000
PORTION_FILES = 64
CLOSING_DAYS = ("1998-03-01", "1998-06-01", "1998-08-02")
SELECTING_DAYS = ("1994-01-01", "1998-08-02")


def query(fn: Callable[[Entities], DataFrame]) -> Callable[[Entities], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Entities(spark, sf_dir))
    return fn


def _r(value, digits: int = 6) -> Column:
    return F.round(value, digits)


def _ts(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _list(column) -> Column:
    return F.array_join(column, "|")


query(shortlist_by_match)


# ---- scans, sources, sinks ----------------------------------------------


@query
def doc_scan(e):
    # A genuine U+FFFD, a lone byte, a sequence that breaks off, and one that is no character.
    raw = F.concat(
        F.encode("text", "UTF-8"), F.unhex(F.lit("EFBFBD" "FF" "E282" "41" "EDA080")), F.encode(F.lit("\r\nend"), "UTF-8")
    )
    return e.documents().select("doc_id", readers.decoded(raw).alias("text"))


@query
def doc_files_scan(e):
    """Every benchmark text from a file of its own, one in three with a broken byte."""
    broken = F.when(F.col("item_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.encode("text", "UTF-8"), broken, F.encode(F.lit("\r\nend"), "UTF-8"))
    path = new_table_path(e.spark, "text-files")
    files = e.table("benchmark").select(raw.cast("string").alias("value"))
    files.write.options(maxRecordsPerFile=1, compression="none").text(path)
    return readers.doc_scan(e.spark, path).select("text")


@query
def doc_ext_filter(e):
    ext = F.get(
        F.array(*[F.lit(x) for x in (".pdf", ".TXT", ".docx", ".txt", "", ".Pdf.zip")]),
        (F.col("doc_id") % 6).cast("int"),
    )
    paths = e.documents().select(
        "doc_id", F.concat("source", F.lit("/cv."), F.col("doc_id").cast("string"), ext).alias("path")
    )
    return readers.doc_ext_filter(paths)


@query
def question_bank_scan(e):
    q = e.questions()
    item = F.struct(
        "question_text", "question_type", "difficulty", "category", "correct_answer",
        F.array(
            F.struct(
                F.col("question_id").cast("string").alias("input"),
                F.col("question_text").alias("expected_output"),
            )
        ).alias("test_cases"),
        F.col("question_text").alias("reference_answer"),
    )
    # Blocks of fixed size, one JSON array and one file each.
    blocks = (
        q.groupBy(F.floor(F.col("question_id") / QUESTIONS_PER_FILE).alias("block"))
        .agg(F.to_json(F.collect_list(item)).alias("value"))
    )
    path = new_table_path(e.spark, "question-bank")
    blocks.write.partitionBy("block").text(path)
    return readers.question_bank_scan(e.spark, path).select(
        "question_text", "question_type", "difficulty", "category", "correct_answer",
        F.col("test_cases")[0]["input"].alias("case_input"),
        F.col("test_cases")[0]["expected_output"].alias("case_output"),
        "reference_answer",
    )


@query
def span_corpus_scan(e):
    """Every benchmark text as a file of its own, one in ten cut short."""
    items = e.table("benchmark").select(
        "item_id",
        F.to_json(
            F.struct("text", F.array(F.array(F.lit("0"), F.lit("4"), F.lit("SKILL: x"))).alias("annotations"))
        ).alias("json"),
    )
    cut = F.when(F.col("item_id") % 10 == 3, F.substring_index("json", '"annotations"', 1))
    path = new_table_path(e.spark, "span-corpus")
    items.select(F.coalesce(cut, "json").alias("value")).write.options(
        maxRecordsPerFile=1, compression="none"
    ).text(path)
    return _span_corpus(e.spark, path)


def _span_corpus(spark, path):
    good, bad = readers.span_corpus_scan(spark, path, pattern="*")
    return good.select("text", F.size("annotations").alias("spans"), F.lit("read").alias("status")).union(
        bad.select("text", F.lit(None).cast("int"), F.lit("unreadable"))
    )


@query
def span_jsonl_scan(e):
    path = new_table_path(e.spark, "span-lines")
    e.span_items().select(F.to_json(F.struct("text", "annotations")).alias("value")).write.text(path)
    rows = readers.span_jsonl_scan(e.spark, path)
    return rows.select("text", F.size("annotations").alias("n"), F.col("annotations")[0][2].alias("label"))


@query
def category_dim_scan(e):
    """Files of label maps, one map per nation."""
    path = new_table_path(e.spark, "label-map")
    entry = F.create_map(F.col("n_nationkey").cast("string"), "n_name")
    e.table("nation").select(F.to_json(entry).alias("value")).write.text(path)
    return readers.category_dim_scan(e.spark, path, lines=True)


@query
def entity_scan(e):
    return e.table("customer")


@query
def activity_sink(e):
    path, checkpoint = live.stream_places(e.spark, "activity")
    live.activity_sink(_log_stream(e), path, checkpoint).awaitTermination()
    stored = e.spark.read.schema(schemas.ACTIVITY + ", logged_at timestamp").parquet(path)
    return stored.where("logged_at is not null").select(
        "event_id", "candidate_id", "flags", "suspicious", _ts("ts").alias("ts")
    )


def _log_stream(e: Entities) -> DataFrame:
    events = e.spark.readStream.schema(e.table("events").schema).parquet(
        e.sf_dir, pathGlobFilter="events.parquet"
    )
    return e.logs(events)


@query
def vector_backfill(e):
    answers = e.table("conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "assistant", "subjective").otherwise("mcq").alias("question_type"),
        F.when(F.col("turn") % 5 != 3, F.col("text")).alias("reference_answer"),
    )
    stored = sinks.vector_backfill(answers, LETTERS)
    rows = stored.select("conv_id", "turn", "question_type", F.posexplode_outer("reference_vector").alias("i", "x"))
    return rows.withColumn("x", F.col("x").cast("double"))


@query
def score_writeback(e):
    lines = e.table("lineitem").groupBy(F.col("l_orderkey").alias("app_id")).agg(
        F.sum("l_quantity").alias("score")
    )
    rows = e.applications().select("app_id", "job_id", "score")
    return sinks.score_writeback(rows, lines, "app_id")


# ---- projections, filters ------------------------------------------------


def _job_columns(df: DataFrame) -> DataFrame:
    return df.select("job_id", "job_title", _ts("deadline").alias("deadline"), "email_sent", "active")


@query
def jobs_due(e):
    return _job_columns(lifecycle.jobs_due(e.jobs(), now()))


@query
def candidates_due(e):
    due = lifecycle.candidates_due(e.candidates(), now())
    return due.select("candidate_id", "job_id", _ts("final_deadline_date").alias("due_at"))


@query
def ttl_expired(e):
    rows = e.jobs()
    gone = lifecycle.ttl_expired(rows, now()).select("job_id", F.lit(True).alias("expired"))
    return gone.union(lifecycle.ttl_kept(rows, now()).select("job_id", F.lit(False)))


@query
def question_pool(e):
    pool = lifecycle.question_pool(e.questions(), "devops engineer", "intermediate", "mcq")
    return pool.select("question_id", "question_text", "correct_answer")


@query
def has_vectors(e):
    vecs = e.vector_documents()
    listed = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<array<float>>")).when(
        F.col("doc_id") % 4 != 1, F.col("vectors")
    )
    rows = lifecycle.has_vectors(vecs.withColumn("vectors", listed))
    return rows.select("doc_id", F.size("vectors").alias("chunks"))


@query
def rows_by_owner(e):
    return lifecycle.rows_by_owner(e.jobs(), "provider_id", 7).select("job_id", "provider_id", "job_title")


@query
def final_deadline(e):
    return e.jobs().select("job_id", _ts(lifecycle.final_deadline(F.col("deadline"))).alias("final_deadline"))


def _with_user(e: Entities, rows: DataFrame) -> DataFrame:
    return rows.join(e.seekers().select("seeker_id", "user_id"), "seeker_id")


@query
def invite_rows(e):
    top = ranking.shortlist_top_fraction(e.applications()).select("app_id", "job_id", "seeker_id")
    return lifecycle.invite_rows(
        _with_user(e, top).drop("seeker_id"), e.jobs(), e.users(), "http://example.com/test"
    )


# ---- text cleaning -------------------------------------------------------


def _text_query(name: str, fn: Callable[[Column], Column]) -> None:
    QUERIES[name] = lambda spark, sf_dir: Entities(spark, sf_dir).documents().select(
        "doc_id", fn(F.col("text")).alias("text")
    )


for _name in (
    "pii_strip", "section_header_strip", "format_artifact_strip", "ascii_punct_normalise",
    "short_token_filter", "clean_text", "nfc_newlines",
):
    _text_query(_name, getattr(cleaning, _name))


@query
def chunk_words(e):
    return e.documents().select(
        "doc_id", F.posexplode(cleaning.chunk_words(F.col("text"))).alias("chunk_no", "chunk")
    )


for _name in ("title", "experience", "salary", "location", "body"):
    QUERIES[f"jd_{_name}"] = (
        lambda spark, sf_dir, name=_name: Entities(spark, sf_dir).job_texts().select(
            "job_id", getattr(jd_fields, f"jd_{name}")(F.col("text")).alias(name)
        )
    )


@query
def jd_all_fields(e):
    return e.job_texts().select("job_id", jd_fields.jd_fields(F.col("text")).alias("f")).select("job_id", "f.*")


QUERIES["jd_fields"] = QUERIES.pop("jd_all_fields")


def _labels(e: Entities) -> DataFrame:
    key = F.col("p_partkey")
    names = F.array(*[F.lit(c) for c in cat.CATEGORIES])
    name = F.get(names, (key % 7).cast("int"))
    form = F.floor(key / 7) % 6
    label = (
        F.when(form == 0, name)
        .when(form == 1, F.concat(F.lit("category: "), F.upper(name), F.lit(".")))
        .when(form == 2, F.lower(F.substring_index(name, " ", 1)))
        .when(form == 3, F.col("p_name"))
        .when(form == 4, F.lit(""))
        .otherwise(F.concat(name, F.lit(" / "), F.get(names, ((key + 3) % 7).cast("int"))))
    )
    return e.table("part").select(key.alias("job_id"), label.alias("label"), "p_size")


@query
def title_category(e):
    return _labels(e).select("job_id", "label", cat.title_category(F.col("label")).alias("category"))


@query
def experience_bucket(e):
    return _labels(e).select("job_id", cat.experience_bucket(F.col("p_size") % 9).alias("difficulty"))


# ---- skills ---------------------------------------------------------------


def _clean_skill_texts(e: Entities) -> DataFrame:
    return e.skill_texts().withColumn("text", cleaning.clean_text(F.col("text")))


@query
def skill_match(e):
    return skills.skill_match(_clean_skill_texts(e), written(e.skill_phrases(), "phrases"))


def _pool(e: Entities) -> DataFrame:
    # Read twice, for the tokens and for the list of texts: cleaned and stored once.
    stored = written(_clean_skill_texts(e).select("doc_id", "text"), "skill-texts", compression="zstd")
    return skills.skill_pool(stored, written(e.skill_phrases(), "phrases"))


@query
def skill_pool(e):
    return _pool(e).select("doc_id", _list("skills").alias("skills"))


def _skills_and_wanted(e: Entities) -> DataFrame:
    return _pool(e).join(e.skill_texts().select("doc_id", "wanted"), "doc_id")


@query
def skill_overlap(e):
    has, wants = F.col("skills"), F.col("wanted")
    return _skills_and_wanted(e).select(
        "doc_id",
        _list(skills.skill_overlap(has, wants)).alias("shared"),
        _r(skills.overlap_ratio(has, wants)).alias("ratio"),
    )


@query
def missing_skills(e):
    lacking = skills.missing_skills(F.col("skills"), F.col("wanted"))
    return _skills_and_wanted(e).select("doc_id", _list(lacking).alias("missing"))


@query
def label_inventory(e):
    good = spans.span_explode(e.span_items()).where("reason is null")
    return skills.label_inventory(good)


# ---- spans -----------------------------------------------------------------


@query
def span_explode(e):
    return spans.span_explode(e.span_items())


@query
def span_repair(e):
    rows = spans.repaired_rows(spans.span_repair(e.span_items()), "doc_id")
    return rows.select("doc_id", "pos", "s.start", "s.end", "s.label", "s.fixed", "s.reason")


@query
def span_examples(e):
    one = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["label"]))
    return spans.span_examples(spans.span_repair(e.span_items())).select("file", "text", _list(one).alias("spans"))


@query
def span_stats(e):
    return spans.span_stats(spans.span_repair(e.span_items()))


@query
def rejected_sample(e):
    return spans.rejected_sample(spans.span_repair(e.span_items()))


# ---- vectors ----------------------------------------------------------------


@query
def l2_normalise(e):
    v = F.transform(F.col("embedding"), lambda x: x * (F.col("vec_id") % 5).cast("float"))
    unit = e.table("embeddings").select("vec_id", vectors.l2_normalise(v).alias("u"))
    rows = unit.select("vec_id", F.posexplode_outer("u").alias("i", "x"))
    return rows.select("vec_id", "i", _r("x").alias("x"))


@query
def embed(e):
    coded = ml.embed(e.documents(), "text", "vector")
    v = F.col("vector")
    return coded.select("doc_id", F.size(v).alias("dimensions"), _r(vectors.norm(v), 4).alias("length"))


def _letters():
    """A small deterministic model: how often a text holds each letter from a to z."""
    import string

    return lambda texts: [[t.count(c) for c in string.ascii_lowercase] for t in texts]


LETTERS = ml.batch_encoder("letters", _letters)


@query
def embed_batches(e):
    coded = ml.embed(e.documents(), "text", "vector", LETTERS)
    return coded.select("doc_id", F.posexplode("vector").alias("i", "x")).select("doc_id", "i", F.col("x").cast("double").alias("x"))


def _vector_pairs(e: Entities) -> DataFrame:
    """Two vectors per order: those its own and its customer's number pick."""
    n = e.table("embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    own = e.table("embeddings").select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    other = e.table("embeddings").select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return (
        dealt(e.table("orders"))
        .select("o_orderkey", (F.col("o_orderkey") % n).alias("a_id"), (F.col("o_custkey") % n).alias("b_id"))
        .join(own, "a_id")
        .join(other, "b_id")
    )


@query
def cosine_pair(e):
    return _vector_pairs(e).select(
        "o_orderkey", _r(vectors.cosine(F.col("a"), F.col("b"))).alias("similarity")
    )


def _maxsim(e: Entities, fn) -> DataFrame:
    # Stored, so that the joins have plain sides and a hot job can be split.
    docs = written(e.vector_documents(), "chunk-lists")
    return fn(e.vector_applications(), docs, docs)


@query
def chunk_maxsim(e):
    return _maxsim(e, matching.chunk_maxsim).select("app_id", "job_id", _r("score").alias("score"))


@query
def best_chunk(e):
    return _maxsim(e, matching.best_chunk).select(
        "app_id", "jd_chunk", "resume_chunk", _r("similarity").alias("similarity")
    )


@query
def chunk_cross(e):
    return _maxsim(e, matching.chunk_cross).select(
        "app_id", "pairs", _r("lowest").alias("lowest"), _r("mean").alias("mean"), _r("highest").alias("highest")
    )


@query
def vector_match(e):
    a, b = F.col("a"), F.col("b")
    half = F.transform(b, lambda x: x * F.lit(0.5))
    return _vector_pairs(e).select(
        "o_orderkey",
        _r(vectors.distance(a, half)).alias("distance"),
        vectors.vector_match(a, half).alias("is_match"),
    )


# ---- joins ------------------------------------------------------------------


@query
def app_wide(e):
    wide = relations.app_wide(e.applications(), e.jobs(), e.seekers(), e.users())
    return wide.select("app_id", "job_id", "job_title", "seeker_id", "resume", "username", "email", "score")


def _logged_candidates(e: Entities) -> DataFrame:
    return e.table("customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name"))


@query
def candidate_logs(e):
    logs = e.logs().select("candidate_id", "event_id", "suspicious")
    return relations.candidate_logs(_logged_candidates(e), logs)


@query
def candidate_answers(e):
    bridge = e.table("orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("answer_id"))
    answers = e.answers().select("answer_id", "question_id", "value", "price")
    return relations.candidate_answers(_logged_candidates(e), bridge, answers)


def _weighted(e: Entities, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return relations.answer_question_weight(answers or e.answers(), e.questions(), cat.weights_dim(e.spark))


@query
def answer_question_weight(e):
    columns = ["candidate_id", "question_id", "line", "category", "question_type"]
    weighted, rejects = _weighted(e)
    return weighted.select(*columns, "weight").unionByName(
        rejects.select(*columns), allowMissingColumns=True
    )


@query
def apply_once(e):
    """Orders up to the end of 1997 have been taken; the later ones come in."""
    apps = e.applications()
    taken, coming = F.col("applied_at") < F.lit("1998-01-01").cast("timestamp_ntz"), F.struct("applied_at", "app_id")
    fresh = relations.apply_once(apps.where(taken), apps.where(~taken), ["job_id", "seeker_id"], coming)
    return fresh.select("app_id", "job_id", "seeker_id")


@query
def snapshot_asof(e):
    """The last log record of a candidate up to each of their applications."""
    orders = e.table("orders")
    day = F.date_diff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")) % 30
    events = orders.select(
        F.col("o_orderkey").alias("app_id"),
        (F.col("o_custkey") % e.table("events").agg(F.max("user_id").alias("m")).scalar()).alias("user_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=day)).alias("applied_at"),
    )
    versions = e.table("events").select("user_id", F.col("ts").alias("version_ts"), F.col("event_id").alias("version"))
    asof = relations.snapshot_asof(events, versions, "user_id", "applied_at", "app_id", "version_ts", "version")
    return asof.select("app_id", "user_id", _ts("applied_at").alias("applied_at"), "version")


@query
def cascade_delete(e):
    removed = e.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("candidate_id"))
    logs = e.logs().select("candidate_id", F.col("event_id").alias("row_id"))
    bridge = e.table("orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("row_id"))
    left_logs, left_bridge = relations.cascade_delete(removed, "candidate_id", logs, bridge)
    return left_logs.withColumn("child", F.lit("log")).union(left_bridge.withColumn("child", F.lit("answer")))


@query
def cascade_users(e):
    """What is left of all tables when the users of one region leave: their jobs and
    resumes go, the applications and tests for those, and what belongs to the tests."""
    region = e.table("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("user_id"))
    bridge = e.table("lineitem").select(
        F.col("l_orderkey").alias("candidate_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    )
    left = relations.cascade(
        {
            "users": e.users(), "jobs": e.jobs(), "seekers": e.seekers(), "applications": e.applications(),
            "candidates": e.candidates(), "logs": e.logs(), "bridge": bridge,
        },
        {
            "users": "user_id", "jobs": "job_id", "seekers": "seeker_id", "applications": "app_id",
            "candidates": "candidate_id", "logs": "event_id", "bridge": "row_id",
        },
        [
            ("jobs", "provider_id", "users"), ("seekers", "user_id", "users"),
            ("applications", "job_id", "jobs"), ("applications", "seeker_id", "seekers"),
            ("candidates", "job_id", "jobs"), ("candidates", "user_id", "seekers"),
            ("logs", "candidate_id", "candidates"), ("bridge", "candidate_id", "candidates"),
        ],
        {"users": region},
    )
    keys = {"users": "user_id", "jobs": "job_id", "seekers": "seeker_id", "applications": "app_id", "candidates": "candidate_id", "logs": "event_id", "bridge": "row_id"}
    rows = [df.select(F.lit(name).alias("name"), F.col(keys[name]).cast("long").alias("row_id")) for name, df in left.items()]
    return reduce(DataFrame.union, rows)


@query
def not_taken(e):
    invited = e.candidates().select("user_id", "job_id").distinct()
    return relations.not_taken(invited, e.candidates())


# ---- aggregates -------------------------------------------------------------


@query
def application_count(e):
    return ranking.application_count(e.jobs(), e.applications()).select("job_id", "application_count")


@query
def flag_counts(e):
    return activity.flag_counts(_logged_candidates(e).select("candidate_id"), e.logs())


def _answer_rows(e: Entities) -> DataFrame:
    weighted, _ = _weighted(e, dealt(e.answers()))
    n = e.table("embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    named = weighted.withColumns(
        {"r_id": F.col("question_id") % n, "g_id": (F.col("question_id") + F.col("line") * 3) % n}
    ).select("candidate_id", "answer_id", "question_id", "line", "value", "question_type", "correct_answer", "weight", "r_id", "g_id")
    stored = written(named, "answer-rows", compression="zstd")
    return scoring.evidence(stored, e.table("embeddings"), scoring.code_results(e.test_runs()))


@query
def candidate_total(e):
    totals = scoring.candidate_total(scoring.answer_scores(_answer_rows(e)))
    return totals.select("candidate_id", _r("total_score", 4).alias("total_score"))


@query
def jobs_with_due(e):
    return lifecycle.jobs_with_due(e.candidates(), now())


def _clean_documents(e: Entities) -> DataFrame:
    return e.documents().withColumn("text", cleaning.clean_text(F.col("text")))


@query
def tfidf(e):
    return text_stats.tfidf(_clean_documents(e)).select("doc_id", "term", _r("weight").alias("weight"))


def _stuffing(docs: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    return text_stats.stuffing_flag(docs, text_stats.tfidf(docs, blocks=blocks))


@query
def stuffing_flag(e):
    return _stuffing(_clean_documents(e))


def _halves(e: Entities) -> tuple[DataFrame, DataFrame]:
    """The cleaned documents in two parts: models of both are merged."""
    stored = written(_clean_documents(e).select("doc_id", "text"), "clean-texts")
    first = F.xxhash64("doc_id") % 2 == 0
    return stored.where(first), stored.where(~first)


def _turns(e: Entities) -> DataFrame:
    """Texts that no model of the documents has counted."""
    name = F.concat_ws("/", "conv_id", "turn").alias("doc_id")
    return dealt(e.table("conversations")).select(name, cleaning.clean_text(F.col("text")).alias("text"))


@query
def term_model(e):
    """Document frequencies: those of one half of the documents, saved, loaded and
    merged with those of the other."""
    one, two = (text_stats.TermModel.fit(half) for half in _halves(e))
    both = text_stats.TermModel(e.spark, one.path).merged(two)
    return both.frequencies().withColumn("n", both.documents().scalar())


@query
def stuffing_unseen(e):
    """Flags of conversation turns by the term weights of the documents."""
    one, two = (text_stats.TermModel.fit(half) for half in _halves(e))
    turns = written(_turns(e), "turns")
    return text_stats.stuffing_flag(turns, text_stats.tfidf(turns, model=one.merged(two)))


@query
def perplexity_unseen(e):
    """Perplexity of conversation turns by the word pairs of the documents."""
    one, two = (text_stats.PairModel.fit(half) for half in _halves(e))
    scored = text_stats.perplexity(written(_turns(e), "turns"), model=one.merged(two))
    flagged = text_stats.generated_text_flag(scored, limit=1000.0)
    return flagged.select("doc_id", _r("perplexity", 4).alias("perplexity"), "is_suspicious_ai")


# ---- rankings ---------------------------------------------------------------


@query
def top_jobs_by_count(e):
    return ranking.top_jobs_by_count(e.jobs(), e.applications()).select("job_id", "application_count")


@query
def top_jobs_by_date(e):
    return ranking.top_jobs_by_date(e.jobs()).select("job_id", _ts("posted_at").alias("posted_at"))


def _flags(e: Entities) -> DataFrame:
    """The flags of the documents, each stored by itself: what one takes is gone when the next begins."""
    docs = _clean_documents(e).select("doc_id", "text")
    found = settled(lambda: _pool(e), "skills")
    # The texts serve two flags: cleaned and coded once.
    blocks = text_stats.coded_texts(docs)
    stuffing = settled(lambda: _stuffing(docs, blocks), "stuffing-flags")
    return ranking.document_flags(stuffing, settled(lambda: _generated(docs, blocks), "generated-flags"), found)


@query
def job_ranking(e):
    docs = e.table("documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    apps = e.applications().select("job_id", "app_id", "score", (F.col("app_id") % docs).alias("doc_id"))
    ranked = ranking.job_ranking(apps, settled(lambda: _flags(e), "document-flags"))
    return ranked.select("job_id", "rank", "app_id", "score", "is_suspicious", "is_suspicious_ai", _list("skills").alias("skills"))


@query
def shortlist_top_fraction(e):
    top = ranking.shortlist_top_fraction(e.applications())
    return top.select("job_id", "rank", "app_id", "score", "group_rows")


@query
def final_rows(e):
    top = ranking.final_selection(e.candidates()).select("candidate_id", "job_id", F.col("user_id").alias("seeker_id"))
    return lifecycle.final_rows(_with_user(e, top).drop("seeker_id"), e.jobs(), e.users())


@query
def empty_guard(e):
    """Selected applications per job: none where nobody applied."""
    top = ranking.shortlist_top_fraction(e.applications()).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return e.jobs().select("job_id").join(top, "job_id", "left").select(
        "job_id", F.coalesce("n", F.lit(0).cast("long")).alias("selected")
    )


@query
def final_selection(e):
    top = ranking.final_selection(e.candidates())
    return top.select("job_id", "rank", "candidate_id", "total_score", "group_rows")


@query
def stratified_test(e):
    draw = sampling.stratified_test(e.questions(), "round-1")
    return draw.select("category", "difficulty", "question_type", "draw", "question_id")


@query
def test_per_candidate(e):
    """A drawn test for every candidate that has not submitted one, by the
    experience the job asks for."""
    topics = F.array(*[F.lit(row[0]) for row in cat.WEIGHTS], F.lit("unlisted"), F.lit("no questions"))
    jobs = e.jobs().select(
        "job_id", F.get(topics, (F.col("job_id") % 9).cast("int")).alias("category"),
        cat.experience_bucket(F.col("experience")).alias("difficulty"),
    )
    starts = e.candidates().where(~F.col("test_taken")).join(jobs, "job_id")
    drawn = sampling.test_per_candidate(starts, e.questions(), "round-1")
    return drawn.select("candidate_id", "question_type", "draw", "question_id")


@query
def first_match(e):
    """The first submitted test, if any, per user and job."""
    taken = e.candidates().where("test_taken")
    return taken.groupBy("user_id", "job_id").agg(F.min("candidate_id").alias("candidate_id"))


@query
def question_union(e):
    draw = sampling.question_union(e.questions(), "round-1")
    return draw.select("category", "difficulty", "question_type", "draw", "question_id")


@query
def distinct_rows(e):
    return sampling.distinct_rows(e.questions().select("category", "difficulty", "question_type"))


# ---- scoring ----------------------------------------------------------------


@query
def score_choice(e):
    rows, _ = _weighted(e)
    score = scoring.score_choice(F.col("value"), F.col("correct_answer"), F.col("weight"))
    return rows.where(F.col("question_type").isin("mcq", "objective")).select(
        "candidate_id", "question_id", "line", _r(score).alias("score")
    )


@query
def score_subjective(e):
    score = scoring.score_subjective(F.col("a"), F.col("b"), F.lit(1.0))
    return _vector_pairs(e).select("o_orderkey", _r(score).alias("score"))


@query
def score_code(e):
    answers = e.table("orders").select(F.col("o_orderkey").alias("answer_id"))
    out = answers.select("answer_id")
    for name, strict in (("score", False), ("strict_score", True)):
        passed = scoring.code_results(e.test_runs(), strict=strict).withColumnRenamed("all_passed", f"_{name}")
        out = out.join(passed, "answer_id", "left").withColumn(
            name, _r(scoring.score_code(F.col(f"_{name}"), F.lit(0.4)))
        ).drop(f"_{name}")
    return out


@query
def weights_dim(e):
    """Questions and weight per category and type, with the category's sum."""
    dim = cat.weights_dim(e.spark)
    sums = dim.groupBy("category").agg(_r(F.sum("weight")).alias("category_sum"))
    counts = e.questions().groupBy("category", "question_type").agg(F.count(F.lit(1)).alias("questions"))
    return dim.join(sums, "category").join(counts, ["category", "question_type"], "left").select(
        "category", "question_type", "weight", "category_sum", F.coalesce("questions", F.lit(0).cast("long")).alias("questions")
    )


@query
def answer_scores(e):
    return scoring.answer_scores(_answer_rows(e)).select(
        "candidate_id", "question_id", "line", "selected_option", "written_answer", _r("score").alias("score")
    )


@query
def composite_rank(e):
    lines = e.table("lineitem").groupBy("l_orderkey").agg(
        (F.max("l_quantity") / 50).alias("objective"),
        (F.max("l_discount") * 10).alias("subjective"),
        (F.max("l_tax") * 10).alias("aptitude"),
        F.avg((F.col("l_linestatus") == "F").cast("double")).alias("programming"),
    )
    parts = e.applications().withColumn("resume_match", F.col("score") / 500000).join(
        lines, F.col("app_id") == F.col("l_orderkey"), "left"
    )
    parts = parts.join(e.jobs().select("job_id", F.col("job_title").alias("role")), "job_id")
    weights = e.spark.createDataFrame(
        [("MACHINERY Engineer", "programming", 0.30), ("MACHINERY Engineer", "aptitude", 0.0)],
        "role string, part string, weight double",
    )
    # Partial scores are stored as they come in; the ranking counts and reads them.
    parts = written(parts.drop("l_orderkey"), "partial-scores")
    ranked = scoring.composite_rank(parts, "job_id", "app_id", weights)
    return ranked.select("job_id", "rank", "app_id", _r("final_score", 10).alias("final_score"))


# ---- models and text statistics ----------------------------------------------


@query
def category_classify(e):
    """Vectors whose first seven numbers tell the label apart, so that every
    prediction has one right answer."""
    label = F.col("label") % 7
    sign = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
    vecs = e.table("embeddings").select(
        "vec_id", F.concat(sign, F.slice("embedding", 1, 3)).alias("vector"), label.alias("label")
    )
    fitted = ml.fit_category_model(vecs)
    model = ml.loaded_model(ml.saved_model(e.spark, fitted))
    first = ml.category_classify(vecs, fitted).withColumnRenamed("prediction", "_first").drop("category")
    out = ml.category_classify(first, model)
    return out.select(
        "vec_id", "label", F.col("prediction").cast("int").alias("predicted"), "category",
        (F.col("prediction") == F.col("_first")).alias("reload_agrees"),
    )


@query
def label_decode(e):
    return e.table("embeddings").select("vec_id", cat.label_decode(F.col("label") % 7).alias("category"))


def _generated(docs: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    return text_stats.generated_text_flag(text_stats.perplexity(docs, blocks=blocks), limit=1000.0)


@query
def perplexity(e):
    scored = text_stats.perplexity(_clean_documents(e))
    return scored.select("doc_id", _r("perplexity", 4).alias("perplexity"))


@query
def generated_text_flag(e):
    return _generated(_clean_documents(e)).select("doc_id", "is_suspicious_ai")


@query
def repetition_ratio(e):
    return e.documents().select("doc_id", _r(text_stats.repetition_ratio(F.col("text"))).alias("ratio"))


@query
def buzzword_density(e):
    return e.documents().select("doc_id", _r(text_stats.buzzword_density(F.col("text"), BUZZWORDS)).alias("density"))


# ---- streams and ticks ---------------------------------------------------------


@query
def activity_stream_counts(e):
    """All events in several files, none in order of time, and every tenth again in
    another file; one file comes at a time."""
    arriving, (path, checkpoint) = new_table_path(e.spark, "arriving"), live.stream_places(e.spark, "counts")
    events = e.table("events")
    events.repartition(5, F.col("event_id") % 5).write.mode("append").parquet(arriving)
    events.where("event_id % 10 = 0").repartition(2, "event_id").write.mode("append").parquet(arriving)
    stream = e.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    live.activity_stream_counts(e.logs(stream), path, checkpoint).awaitTermination()
    return live.current_counts(e.spark, path)


@query
def close_due_jobs(e):
    top, closed = lifecycle.close_due_jobs(e.jobs(), e.applications(), now())
    picked = top.groupBy("job_id").agg(F.count(F.lit(1)).alias("selected"), F.min("app_id").alias("lowest_app"))
    return _job_columns(closed).join(picked, "job_id", "left")


@query
def close_once(e):
    """Three ticks, the last one twice: every job is closed by the first it is due at."""
    path = new_table_path(e.spark, "closing")
    for day in (*CLOSING_DAYS, CLOSING_DAYS[-1]):
        at = F.lit(day).cast("timestamp_ntz")
        due = lifecycle.jobs_due(e.jobs(), at).select("job_id")
        ticks.handled_once(
            due, "job_id", path, day,
            lambda jobs: ranking.shortlist_top_fraction(e.applications().join(jobs, "job_id", "left_semi")),
        )
    return ticks.outcomes(e.spark, "job_id", path).select("job_id", "app_id", "rank", F.col("tick").alias("closed_at"))


@query
def final_select_once(e):
    """Two ticks, the last one twice: every job's final selection is made once."""
    path = new_table_path(e.spark, "selecting")
    for day in (*SELECTING_DAYS, SELECTING_DAYS[-1]):
        due = lifecycle.jobs_with_due(e.candidates(), F.lit(day).cast("timestamp_ntz"))
        ticks.handled_once(
            due, "job_id", path, day,
            lambda jobs: ranking.final_selection(e.candidates().join(jobs, "job_id", "left_semi")),
        )
    out = ticks.outcomes(e.spark, "job_id", path)
    return out.select("job_id", "candidate_id", "rank", F.col("tick").alias("selected_at"))


@query
def final_select_tick(e):
    selected, flagged = lifecycle.final_select_tick(e.candidates(), now())
    mark = selected.select("candidate_id", F.col("rank").alias("selected_rank"))
    return flagged.select("candidate_id", "job_id", "final_email_sent").join(mark, "candidate_id", "left")


@query
def rescore_on_apply(e):
    path, checkpoint = live.stream_places(e.spark, "rescored")
    orders = e.spark.readStream.schema(e.table("orders").schema).parquet(
        e.sf_dir, pathGlobFilter="orders.parquet"
    )
    docs = written(e.vector_documents(), "chunk-lists")  # not listed anew for each batch
    # A stream cannot read a subquery's value inside its own plan: take it first.
    n = e.table("embeddings").count()
    apps = orders.select(
        F.col("o_orderkey").alias("app_id"),
        (F.col("o_orderkey") % F.ceil(F.lit(n) / 4)).alias("resume_id"),
        (F.col("o_custkey") % F.ceil(F.lit(n) / 4)).alias("jd_id"),
    )
    live_apps.rescore_on_apply(apps, docs, docs, path, checkpoint).awaitTermination()
    return e.spark.read.parquet(path).select("app_id", _r("score").alias("score"))


def _category_model(e: Entities):
    labelled = ml.embed(e.documents(), "text", "vector").withColumn("label", F.length("lang") % 7)
    return ml.fit_category_model(labelled, trees=5)


def _updated(resumes: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, cat.CATEGORIES))
    return resumes.select(
        "owner", "doc_id", "text", F.size("vectors").alias("chunks"),
        F.transform("vectors", lambda v: F.size(v)).cast("string").alias("dimensions"),
        F.array_contains(names, F.col("category")).alias("has_category"),
        _list("skills").alias("skills"),
    )


@query
def resume_update(e):
    """The newest text per source and language, prepared anew."""
    docs = e.skill_texts().select("owner", "doc_id", "text")
    latest = live_apps.latest_versions(docs, "owner", F.col("doc_id"))
    return _updated(live_apps.prepared(latest, e.skill_phrases(), _category_model(e)))


@query
def resume_update_stream(e):
    """All versions in three portions, each with old and new ones, and the first portion
    once more at the end; one portion comes at a time, in files of a task each."""
    arriving, (path, checkpoint) = new_table_path(e.spark, "versions"), live.stream_places(e.spark, "resumes")
    docs = written(e.skill_texts().select("owner", "doc_id", "text"), "resume-versions")
    for part in (0, 2, 1, 0):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == part).repartition(PORTION_FILES, "doc_id").write.mode("append").parquet(arriving)
    stream = e.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", PORTION_FILES).parquet(arriving)
    phrases = written(e.skill_phrases(), "phrases")  # read by every batch
    live_apps.resume_update_stream(stream, phrases, _category_model(e), path, checkpoint, merged=2).awaitTermination()
    return _updated(live_apps.resumes(path, merged=2).current(e.spark))
