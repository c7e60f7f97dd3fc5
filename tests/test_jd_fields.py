"""One text per pattern, and the rules for going on to the next one."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import jd_fields as J

CASES = [
    ("title", "[Job Title]: Cloud Engineer!\nx", "Cloud Engineer"),
    ("title", "x y.\n**Position**: Lead Tester\n", "Lead Tester"),
    ("title", "Senior QA Engineer | Remote | $95K\n.", "Senior QA Engineer"),
    ("title", "it is.\n\n  Data Engineer (EU)  \n.", "Data Engineer (EU)"),
    ("title", "we're hiring: Full Stack Developer, now.", "Full Stack Developer, now"),
    ("title", "hey, looking for a Platform Engineer!", "Platform Engineer"),
    ("title", "Title: 12\n**Role**: Welder\n", "Welder"),
    ("title", "Title: --\nit is.", None),
    ("title", "Role:\n  Next Line\n", "Next Line"),
    ("title", "nothing here.", None),
    ("experience", "minimum of 3 to 5 years of relevant experience", "3 to 5 years of relevant experience"),
    ("experience", "5+ years of work experience", "5+ years of work experience"),
    ("experience", "4 years exp.", "4 years exp."),
    ("experience", "Min. Experience: five | more", "five"),
    ("experience", "Experience - 3–5 Years, more\nx", "3–5 Years, more"),
    ("experience", "spent at least 4 years wrangling", "4 years"),
    ("experience", "none", None),
    ("salary", "Salary: USD 100,000 - 120,000 per year, DOE\n", "USD 100,000 - 120,000 per year, DOE"),
    ("salary", "from $90K–$110K here", "$90K–$110K"),
    ("salary", "£85,000 per annum", "£85,000 per annum"),
    ("salary", "Pay: Negotiable", "Negotiable"),
    ("salary", "Pay: TBD", None),
    ("salary", "Pay: Open ($45,000/yr)", "$45,000/yr"),
    ("location", "Work Location: Austin, TX 78701.\nx", "Austin, TX 78701"),
    ("location", "📍New York, NY | Remote", "New York, NY"),
    ("location", "location ..... Berlin;\n", "Berlin"),
    ("location", "Tester | Hybrid (2 days) | $9", "Hybrid (2 days)"),
    ("location", "see Kansas City, MO soon", "Kansas City, MO"),
    ("location", "it is fully remote – US only", "fully remote – US only"),
    ("location", "we are based out of Lisbon with a team", "Lisbon"),
    ("location", "Location: NY\nsee Paris, France", None),
    ("location", "none", None),
    ("body", "Title: x\n\nJob Description:\n\n Do things.\n", "Do things."),
    ("body", "Title: x\nTeamwork is ours\n\nWe build.\nMore", "We build.\nMore"),
    ("body", "Title: x\nRole: y", "Title: x\nRole: y"),
    ("body", "a\r\nOverview\nrest", "rest"),
    ("body", "| a | b |\nprose\x0bnext", "prose\nnext"),
    ("body", "Overview\n", ""),
    ("body", "| a | b ||\nx", "| a | b ||\nx"),
    ("body", "| a" * 20000 + "\nprose", "prose"),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, t string")
    out = df.select("i", J.jd_fields(F.col("t")).alias("f")).collect()
    return {r.i: r.f.asDict() for r in out}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_field(found, i):
    field, text, expected = CASES[i]
    assert found[i]["description_body" if field == "body" else field] == expected, text
