"""Gold cases of whole fragments, and references, against exact small cases."""

from quern.operators import gold, references


def test_gold_cases_match_whole_fragments(spark):
    head = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(head + " but then another end",), ("x" + head[3:] + " whole end y",), ("ab c",), (None,)], "text string")
    cases = spark.createDataFrame([("cut", [head + " whole end"], None), ("kept", [head + " but then another"], ["no such"]), ("bad", [], ["b c", "gone"]), ("none", [], [])], "case_id string, expected array<string>, forbidden array<string>")
    fragments = cases.selectExpr("explode(concat(expected, coalesce(forbidden, array()))) AS fragment")
    got = {r["case_id"]: (len(r["missing"]), r["forbidden"], r["passed"], r["pass_rate"]) for r in gold.verdicts(cases, gold.hits(docs, fragments)).collect()}
    assert got == {"cut": (1, [], False, 0.5), "kept": (0, [], True, 0.5), "bad": (0, ["b c"], False, 0.5), "none": (0, [], True, 0.5)}


def test_gold_hits_take_any_number_of_fragments(spark):
    docs = spark.createDataFrame([(f"start {i} a b c d{i % 7} e f end",) for i in range(3000)], "text string")
    fragments = spark.createDataFrame([(f"t {i} a b c d{i % 7} e",) for i in range(2000)], "fragment string")
    found = gold.hits(docs, fragments)
    assert found.count() == 2000 and found.where("hits <> 1").count() == 0


def test_references_have_any_number_of_referrers(spark):
    defs = spark.createDataFrame([("d1", "loadUser", "a"), ("d2", "twice", "a"), ("d3", "twice", "b"), ("d4", "Render", "b"), ("d5", "quoted", "b"), ("d6", "this", "a")], "id string, name string, file string")
    files = [(f"f{i}", "x = loadUser(1); twice; Render() # quoted\n'quoted' this") for i in range(5)] + [("a", "loadUser"), ("n", None)]
    got = {tuple(r) for r in references.enrich(spark.createDataFrame(files, "file string, text string"), defs).collect()}
    assert got == {(f"f{i}", t, n) for i in range(5) for t, n in (("d1", "loadUser"), ("d6", "this"))}
    many = spark.createDataFrame([(f"d{i}", f"name{i:03d}", "a") for i in range(80)], "id string, name string, file string")
    one = spark.createDataFrame([("f", " ".join(f"name{i:03d}" for i in range(79, -1, -1)))], "file string, text string")
    assert sorted(r["target"] for r in references.enrich(one, many).collect()) == sorted(f"d{i}" for i in range(20, 80))
