import random
import re

from pyspark.sql import functions as F

from fleetlife.functions.pattern_index import candidates, indexed_patterns, required_literals
from fleetlife.operators import dims


def test_required_literals():
    assert required_literals("TOSHIBA.+(AL|DT)") == ["TOSHIBA"]
    assert required_literals("^NATION_1 ") == ["NATION_1 "]
    assert required_literals("abcd|x+wxyz") == ["abcd", "wxyz"]
    assert required_literals("abcd?") == ["abc"] and required_literals("abcd{0,2}ef") == ["abc"]
    assert required_literals(r"a\.bc\d") == ["a.bc"]
    assert required_literals("abc+de") == ["abc"] and required_literals("(?:abc)?xyz[|(]") == ["xyz"]
    for unsure in ("", "ab", "abc|d", "(abc)", "(?i)abcd", r"\Qabcd\E", "[]abcd]", "[^]abc]x", "abcd(", "[abcd", r"\x41bcd", "(?s)abc"):
        assert required_literals(unsure) is None, unsure


def random_pattern(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.randrange(8 if depth < 2 else 6)
        if kind < 4:
            parts.append("".join(rng.choice("abc.") for _ in range(rng.randint(1, 5))).replace(".", rng.choice([r"\.", "."])))
        elif kind == 4:
            parts.append(rng.choice(["[ab]", "[^c)]", "[(|b]", r"\w", r"\d", r"[\]a]"]))
        elif kind == 5:
            parts.append("a" + rng.choice(["?", "*", "+", "{2}", "{0,1}", "+?", "??"]))
        else:
            parts.append(rng.choice(["(", "(?:"]) + random_pattern(rng, depth + 1) + ")" + rng.choice(["", "?", "*", "+"]))
    return rng.choice(["", "", "^"]) + "".join(parts) + (
        "|" + random_pattern(rng, depth + 1) if depth < 2 and rng.random() < 0.3 else "")


def test_every_match_holds_a_required_literal():
    rng, matches = random.Random(3), 0
    for _ in range(4000):
        pattern = random_pattern(rng)
        literals = required_literals(pattern)
        if literals is None:
            continue
        for _ in range(20):
            text = "".join(rng.choice("abc.") for _ in range(rng.randint(0, 12))) + rng.choice(literals)
            if re.search(pattern, text):
                matches += 1
                assert any(x in re.search(pattern, text).group(0) for x in literals), (pattern, text, literals)
    assert matches > 1000


def test_few_pairs_are_tried(spark):
    patterns = spark.range(10_000).select(
        F.col("id").alias("_id"), F.format_string(r"^MAKER %05d \w+|BRAND-%05d\d*", F.col("id"), F.col("id")).alias("_rx"))
    names = spark.range(300).select(F.format_string("MAKER %05d X", F.col("id") * 31).alias("_name"))
    rare, always = indexed_patterns(patterns)
    assert always.count() == 0
    tried = candidates(names, rare)
    assert tried.count() < 0.01 * 300 * 10_000
    assert tried.where(F.rlike("_name", F.col("_rx"))).distinct().count() == 300


def test_brands_with_and_without_literals(spark):
    brands = spark.createDataFrame(
        [(1, r"X\d"), (2, "ABCD"), (3, "BCD|ZZZ9"), (4, "(?i)abcd"), (5, ""), (6, None)], "id int, model_name_regex string")
    names = ["ABCDX1", "ABCD", "BCD", "zzz ZZZ9", "abcd", "none", "", None, "ab"]
    models = spark.createDataFrame([(n,) for n in names + names], "name string")
    got = dims.classify_models(models, brands).collect()
    assert len(got) == 2 * len(names)
    want = {"ABCDX1": 1, "ABCD": 2, "BCD": 3, "zzz ZZZ9": 3, "abcd": 4}
    assert all(r.brand_id == want.get(r["name"]) for r in got)
    none = dims.classify_models(models, brands.where("id > 4"))
    assert none.count() == 2 * len(names) and none.where("brand_id is not null").count() == 0
