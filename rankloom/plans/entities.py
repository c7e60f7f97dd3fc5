"""The entities as views of the generated tables.

Jobs, applications, questions and so on are derived by Spark from the whole
tables; nothing is left out and nothing is made up beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.categories import WEIGHTS
from rankloom.operators.matching import chunk_lists
from rankloom.operators.skills import gazetteer
from rankloom.session import dealt
from rankloom.sources.readers import entity_scan

NOW = "1998-08-02 00:00:00"
CHUNKS_PER_DOC = 4


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _days_after(day: str, days: Column) -> Column:
    return F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(days=days.cast("int"))


def _size(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


class Entities:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return entity_scan(self.spark, self.sf_dir, name)

    # people and jobs

    def jobs(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("job_id"),
            F.col("c_nationkey").alias("provider_id"),
            F.concat("c_mktsegment", F.lit(" Engineer")).alias("job_title"),
            (key % 8).cast("int").alias("experience"),
            _days_after("1997-01-01", key * 7 % 400).alias("posted_at"),
            _days_after("1998-01-01", key * 11 % 365).alias("deadline"),
            (F.col("c_acctbal") < 0).alias("email_sent"),
            (F.col("c_mktsegment") != "HOUSEHOLD").alias("active"),
            _days_after("1998-05-01", key * 3 % 90).alias("created_at"),
            (key % 60 + 1).cast("int").alias("deadline_days"),
        )

    def seekers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("seeker_id"),
            F.col("s_nationkey").alias("user_id"),
            F.concat("s_name", F.lit(".txt")).alias("resume"),
        )

    def users(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("user_id"),
            F.col("n_name").alias("username"),
            F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"),
        )

    def applications(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("app_id"),
            F.col("o_custkey").alias("job_id"),
            (F.col("o_orderkey") % _size(self.table("supplier"))).alias("seeker_id"),
            F.col("o_totalprice").alias("score"),
            F.col("o_orderdate").alias("applied_at"),
        )

    def candidates(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("candidate_id"),
            (F.col("o_orderkey") % _size(self.table("supplier"))).alias("user_id"),
            F.col("o_custkey").alias("job_id"),
            F.col("o_totalprice").alias("total_score"),
            (F.col("o_orderstatus") != "P").alias("test_taken"),
            (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(7))).alias("final_deadline_date"),
            (F.col("o_orderstatus") == "F").alias("final_email_sent"),
        )

    # questions and answers

    def questions(self) -> DataFrame:
        key = F.col("p_partkey")
        categories = [F.lit(row[0]) for row in WEIGHTS] + [F.lit("unlisted")]
        kinds = [F.lit(k) for k in ("code", "objective", "mcq", "subjective")]
        years = F.col("p_size") % 8
        return self.table("part").select(
            key.alias("question_id"),
            F.get(F.array(*categories), F.floor(key / 4).cast("int") % 8).alias("category"),
            F.get(F.array(*kinds), (key % 4).cast("int")).alias("question_type"),
            F.when(years <= 2, "basic").when(years <= 5, "intermediate").otherwise("hard").alias("difficulty"),
            F.col("p_name").alias("question_text"),
            F.get(F.array(F.lit(" a "), F.lit("N"), F.lit("r"), F.lit("")), (F.col("p_size") % 4).cast("int")).alias("correct_answer"),
        )

    def answers(self) -> DataFrame:
        """Test answers: one per order line; some refer to no question."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("candidate_id"),
            F.col("l_orderkey").alias("answer_id"),
            F.when(F.col("l_quantity") >= 49, F.lit(-1)).otherwise(F.col("l_partkey")).alias("question_id"),
            F.col("l_returnflag").alias("value"),
            F.col("l_linenumber").alias("line"),
            F.col("l_extendedprice").alias("price"),
        )

    def test_runs(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("answer_id"),
            F.col("l_linenumber").alias("case_no"),
            F.concat(F.lit(" "), "l_linestatus", F.lit("\n")).alias("stdout"),
            F.when(F.col("l_tax") >= 0.06, "O").otherwise(F.col("l_linestatus")).alias("expected"),
            F.when(F.col("l_discount") >= 0.09, "timeout").alias("error"),
        )

    # vectors

    def chunk_vectors(self) -> DataFrame:
        key = F.col("vec_id")
        return self.table("embeddings").select(
            F.floor(key / CHUNKS_PER_DOC).alias("doc_id"),
            (key % CHUNKS_PER_DOC).cast("int").alias("chunk_no"),
            F.col("embedding").alias("vector"),
        )

    def vector_documents(self) -> DataFrame:
        return chunk_lists(self.chunk_vectors())

    def vector_applications(self, orders: DataFrame | None = None) -> DataFrame:
        docs = F.ceil(_size(self.table("embeddings")) / CHUNKS_PER_DOC)
        # An application is a few numbers, comparing its texts is the work.
        orders = dealt(self.table("orders")) if orders is None else orders
        return orders.select(
            F.col("o_orderkey").alias("app_id"),
            F.col("o_custkey").alias("job_id"),
            (F.col("o_orderkey") % docs).alias("resume_id"),
            (F.col("o_custkey") % docs).alias("jd_id"),
        )

    # activity

    def logs(self, events: DataFrame | None = None) -> DataFrame:
        """Proctoring records with flags in every form the parser must take."""
        events = self.table("events") if events is None else events
        flag = (
            F.when(F.col("event_type") == "view", "notFocused")
            .when(F.col("event_type") == "click", "tabSwitch")
            .when(F.col("event_type") == "signup", "noFaceDetected")
            .when(F.col("event_type") == "purchase", "copyAttempted")
            .when(F.col("value") > 20, "devToolsOpen")
            .otherwise("multiplefacesdetected")
        )
        form = F.col("event_id") % 9
        value = (
            F.when(form == 1, "1").when(form == 2, '"true"').when(form == 3, "false")
            .when(form == 4, "1.0").otherwise("true")
        )
        plain = F.concat(F.lit('{"'), flag, F.lit('": '), value, F.lit(', "k": 3}'))
        quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"'))
        return events.select(
            "event_id",
            F.col("user_id").alias("candidate_id"),
            F.when(form == 5, quoted).when(form == 6, "{}").when(form != 7, plain).alias("flags"),
            (F.col("value") > 50).alias("suspicious"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    # texts

    def documents(self) -> DataFrame:
        return dealt(self.table("documents").select("doc_id", "text", "lang", "source"))

    def skill_phrases(self) -> DataFrame:
        return gazetteer(self._phrases(), "phrase")

    def _phrases(self) -> DataFrame:
        """Phrases of one to three tokens: part names, their first words, types."""
        part = self.table("part")
        return (
            part.select(F.col("p_name").alias("phrase"))
            .union(part.select(F.substring_index("p_name", " ", 1)))
            .union(part.select(F.concat("p_name", F.lit("-"), F.lower("p_type"))))
            .distinct()
        )

    def skill_texts(self) -> DataFrame:
        """Every document with the names of two parts worked into its end."""
        parts = self.table("part").select("p_partkey", "p_name", "p_type")
        n = _size(self.table("part"))
        first = parts.select(F.col("p_partkey").alias("k1"), F.col("p_name").alias("n1"), F.lower("p_type").alias("t1"))
        second = parts.select(F.col("p_partkey").alias("k2"), F.col("p_name").alias("n2"))
        keys = {"k1": F.col("doc_id") % n, "k2": (F.col("doc_id") * 7 + 3) % n}
        # The parts meet before a text does: it is exchanged once at most.
        wanted = self.table("documents").select(*[key.alias(k) for k, key in keys.items()]).distinct()
        return (
            self.documents()
            .withColumns(keys)
            .join(wanted.join(first, "k1").join(second, "k2"), ["k1", "k2"])
            .select(
                "doc_id",
                F.concat_ws("/", "source", "lang").alias("owner"),
                F.concat("text", F.lit("\nSkills: "), F.initcap("n1"), F.lit("-"), "t1", F.lit(", "), "n2", F.lit(". Also: "), "n1", F.lit("!")).alias("text"),
                F.array_distinct(F.array("n1", F.substring_index("n2", " ", 1), F.lit("unseen"))).alias("wanted"),
            )
        )

    def job_texts(self) -> DataFrame:
        """A job description per part, in eight layouts, around a prose text."""
        n = _size(self.table("benchmark"))
        prose = self.table("benchmark").select("item_id", F.col("text").alias("prose"))
        nation = self.table("nation").select("n_nationkey", "n_name")
        key = F.col("p_partkey")
        years = F.col("p_size").cast("string")
        low = F.floor("p_retailprice").cast("string")
        high = (F.floor("p_retailprice") + 500).cast("string")
        title = F.concat(F.initcap("p_name"), F.lit(" Engineer"))
        place = F.concat(F.lit("Port "), F.initcap(F.translate("n_name", "_0123456789", " abcdefghij")))

        def text(*parts) -> Column:
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        layouts = (
            text("Job Title: ", title, "\nLocation: ", place, "\nSalary: $", low, " - $", high, " per year\nExperience: ", years, "+ years of experience\nJob Description:\n", F.col("prose")),
            text(title, " | Remote | $", low, "-$", high, " |\n", F.col("prose")),
            text("**Position:** ", title, "\n📍 ", place, " | Hybrid\nCompensation: DOE\n\n", F.col("prose"), "\nat least ", years, " years of experience"),
            text("We're Hiring: ", title, "\nWork Location ..... ", place, "\nMin. Experience: ", years, " Years | Preferred\nResponsibilities\n\n", F.col("prose")),
            text("hello, we are looking for a ", title, "!\nYou have spent at least ", years, " years here. Pay: Negotiable\n", F.col("prose")),
            text("Role: 12\n", title, "\n\nDepartment: Tools\n", place, ", UK (Remote)\n€", low, " per annum\n", F.col("prose"), "\n(", years, " to 40 years exp.)"),
            text("Department: Tools\nTeam - core\n\nExperience: ", years, "-", years, " Years preferred\n(£", low, "/yr)\nbased out of ", place, ".\n", F.col("prose")),
            text("salary range: USD ", low, "k to ", high, "k annually, DOE\r\nFully Remote (EU)\r\nWhat You'll Do:\n", F.col("prose"), "\n"),
        )
        chosen = F.lit(None).cast("string")
        for i, layout in enumerate(layouts):
            chosen = F.when(key % len(layouts) == i, layout).otherwise(chosen)
        # A part is a few numbers, the text made of it and its patterns are the work.
        return (
            dealt(self.table("part"), always=True)
            .withColumns({"item_id": key % n, "n_nationkey": (key % 25).cast("int")})
            .join(prose, "item_id")
            .join(nation, "n_nationkey")
            .select(key.alias("job_id"), chosen.alias("text"))
        )

    def span_items(self) -> DataFrame:
        """Every document with five spans: good, cut off, reversed, far off,
        and (one in three) malformed."""
        key = F.col("doc_id")
        size = F.length("text")

        def span(start: Column, end: Column, label: str) -> Column:
            return F.array(start.cast("string"), end.cast("string"), F.lit(f"SKILL: {label}"))

        return self.documents().select(
            F.format_string("cv (%d).json", key).alias("file"),
            "doc_id",
            "text",
            F.lit(None).cast("array<array<string>>").alias("spans"),
            F.array(
                span(key % 5, key % 5 + 6, "alpha"),
                span(size - 4, size + key % 9, "beta"),
                span(key % 7 + 5, key % 7 + 3, "gamma"),
                span(size + 3 + key % 90, size + 1 + key % 90, "delta"),
                F.when(key % 3 == 0, F.array(F.lit("x"), F.lit("3"), F.lit("SKILL: bad")))
                .otherwise(span(-key % 4 - 1, F.lit(4), "edge")),
            ).alias("annotations"),
        )
