"""Ticks that run twice, and values that must not change unnoticed."""

import regex
from pyspark.sql import functions as F

from rankloom.functions import categories, cleaning
from rankloom.operators import activity, matching, ml, ticks
from rankloom.session import new_table_path, written


def test_a_job_is_handled_by_one_tick(spark):
    path = new_table_path(spark, "ticks")
    rows = spark.sql("SELECT * FROM VALUES (1L, 'a'), (1L, 'b'), (2L, 'c'), (3L, 'd') AS t(job_id, app)")

    def tick(name, *jobs, fails=False):
        due = spark.createDataFrame([(j,) for j in jobs], "job_id long")
        broken = F.raise_error(F.lit("lost")).isNull()
        outcome = lambda keys: rows.join(keys, "job_id", "left_semi").where(broken if fails else F.lit(True))
        ticks.handled_once(due, "job_id", path, name, outcome)

    def found():
        return sorted((r.job_id, r.app, r.tick) for r in ticks.outcomes(spark, "job_id", path).collect())

    tick("2024-01-01", 1)
    once = [(1, "a", "2024-01-01"), (1, "b", "2024-01-01")]
    assert found() == once
    tick("2024-01-01", 1)
    assert found() == once
    try:
        tick("2024-01-02", 1, 2, fails=True)
    except Exception:  # noqa: BLE001 - the tick breaks off on purpose
        pass
    assert found() == once
    tick("2024-01-03", 1, 2, 4)
    tick("2024-01-03", 1, 2, 4)
    assert found() == [*once, (2, "c", "2024-01-03")]
    tick("2024-01-04")
    assert found() == [*once, (2, "c", "2024-01-03")]


def _murmur3(data: bytes, seed: int = 42) -> int:
    mask, h = 0xFFFFFFFF, seed

    def mixed(k):
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if data[whole:]:
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_vectors_equal_plain_hashing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for row in ml.embed(docs, "text", "vector").collect():
        plain = [0.0] * ml.DIMENSIONS
        for term in regex.findall(r"[\p{L}\p{N}_]{2,}", (row.text or "").lower()):
            plain[_murmur3(term.encode()) % ml.DIMENSIONS] += 1.0
        length = sum(x * x for x in plain) ** 0.5 or 1.0
        assert max(abs(a - b / length) for a, b in zip(row.vector, plain, strict=True)) < 1e-6, row.doc_id


def test_a_hot_job_is_split(spark):
    """Broadcasts off, small thresholds: the executed join says that it was split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = F.col("id")
        docs = written(spark.range(40).select(n.alias("doc_id"), F.array(F.array(n.cast("float"), F.lit(1.0).cast("float"))).alias("vectors")), "lists")
        apps = spark.range(0, 40_000, 1, 8).select(
            n.alias("app_id"), (n % 40).alias("resume_id"), F.when(n % 10 > 0, 7).otherwise(n % 40).cast("long").alias("jd_id")
        )
        scored = matching.chunk_maxsim(apps, docs, docs)
        assert len(scored.collect()) == 40_000
        assert "skew=true" in scored._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---- fixed values -------------------------------------------------------
WEIGHTS = """
datascience 0.40 0.30 0.13 0.17
software developer 0.50 0.30 0.10 0.10
cybersecurity specialist 0.48 0.28 0.14 0.10
devops engineer 0.42 0.30 0.18 0.10
graphics engineer 0.30 0.20 0.20 0.30
machine learning engineer 0.47 0.28 0.10 0.15
robotics engineer 0.46 0.29 0.10 0.15
"""
FLAG_NAMES = ["notFocused", "multiplefacesdetected", "tabSwitch", "noFaceDetected", "devToolsOpen", "copyAttempted"]
MARKS = "•·▪▫◦‣⁃➢➣►▶❯❭›●○◆◇□■→⇒⇨⟶➔✓✔–—【】《》"
TITLES = """
profile, summary, professional summary, about me, bio, introduction, overview, executive summary
technical skills, skills, core competencies, tech stack, toolbox, expertise, proficiencies, capabilities
soft skills, interpersonal skills
projects, portfolio, featured work, case studies, side projects, key projects, selected projects, notable projects
work experience, professional experience, employment history, career history, work history, relevant experience
education, academic background, formal education, degrees, schooling, coursework
certifications, certificates, credentials, badges, licenses, continuing education
achievements, awards, honors, recognition, accomplishments
languages, spoken languages, human languages
volunteer, community involvement, open source contributions, community work
additional projects, other projects, miscellaneous
references, publications, conferences, speaking, hobbies, interests, memberships
"""
# ---- end of fixed values ------------------------------------------------


def test_fixed_values(spark):
    rows = [line.rsplit(" ", 4) for line in WEIGHTS.strip().splitlines()]
    wanted = {(c, k): float(w) for c, *ws in rows for k, w in zip(("code", "objective", "mcq", "subjective"), ws, strict=True)}
    assert {(r.category, r.question_type): r.weight for r in categories.weights_dim(spark).collect()} == wanted
    assert [name for name, _ in activity.FLAGS] == FLAG_NAMES
    assert cleaning.BULLETS == MARKS
    groups = [line.split(", ") for line in TITLES.strip().splitlines()]
    assert [list(group) for group in cleaning.SECTION_TITLES] == groups
    lines = [(f"kept {title} here",) for group in groups for title in group]
    left = spark.createDataFrame(lines, "t string").select("t", cleaning.section_header_strip(F.col("t")).alias("left"))
    for row in left.collect():
        plain = row.t
        for group in groups:
            plain = regex.sub(rf"(?i)\b({'|'.join(group)})\b", " ", plain)
        assert row.left.split() == plain.split()
