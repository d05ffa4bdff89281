"""Merging engines and generated columns."""

from pyspark.sql import functions as F

from trawlight.operators import generate as g
from trawlight.operators import metasearch as ms
from trawlight.sources.engines import engine_results
from trawlight.sources.seeds import read_seeds

RAW = "query_id bigint, position bigint, title string, href string, body string"


def lists(spark, google, duck):
    return [engine_results(spark.createDataFrame(google, RAW), "google"), engine_results(spark.createDataFrame(duck, RAW), "duckduckgo")]


def test_missing_fields_become_empty(spark):
    got = engine_results(spark.createDataFrame([(1, 1, None, None, None)], RAW), "duckduckgo").first()
    assert (got.title, got.url, got.snippet, got.source_engine) == ("", "", "", "duckduckgo")


def test_first_engine_keeps_the_url(spark):
    both = lists(
        spark,
        [(4, 1, "Reed", "http://wetland.example/reed", "tall"), (4, 2, "Heron", "http://wetland.example/heron", "grey")],
        [(4, 1, "A heron", "http://wetland.example/heron", "bird"), (4, 2, "Newt", "http://wetland.example/newt", "wet")],
    )
    for order in (both, both[::-1]):
        got = ms.merge_results(order).orderBy("engine_seq", "position").collect()
        assert [(r.title, r.source_engine) for r in got] == [("Reed", "google"), ("Heron", "google"), ("Newt", "duckduckgo")]
    only = ms.merge_results(both, engines=["duckduckgo"]).collect()
    assert sorted(r.title for r in only) == ["A heron", "Newt"]
    counts = ms.result_counts(ms.union_engines(*both)).first()
    assert (counts.google_results, counts.duckduckgo_results, counts.unique_results) == (2, 2, 3)


def test_limit_comes_before_filter_and_merge(spark):
    duck = [(1, 1, "a", "", "b"), (1, 2, "b", "http://e/1", "b"), (1, 3, "c", "http://e/2", "b")]
    got = ms.merge_results(lists(spark, [], duck), limit=2).collect()
    assert [r.url for r in got] == ["http://e/1"]
    assert ms.merge_results(lists(spark, [], [])).count() == 0


def test_one_huge_query_is_cut_before_the_shuffle(spark):
    limited = ms.limit_per_engine(ms.union_engines(*lists(spark, [], [(1, 1, "a", "u", "b")])))
    assert "WindowGroupLimit" in limited._jdf.queryExecution().executedPlan().toString()


def backend(calls=None):
    def make(model=None, **options):
        def answer(batch):
            texts = [messages[-1]["content"] for messages in batch]
            if any("fail" in text for text in texts):
                raise RuntimeError("refused")
            return [f"{model}/{options.get('max_tokens')}/{len(messages)}: {text[-5:]}" for messages, text in zip(batch, texts)]

        return answer

    return make


def test_messages(spark):
    table = spark.createDataFrame([("p", "s"), ("p", ""), ("p", None)], "prompt string, system string")
    got = [[(m.role, m.content) for m in r[0]] for r in table.select(g.chat_messages(F.col("prompt"), F.col("system"))).collect()]
    assert got == [[("system", "s"), ("user", "p")], [("user", "p")], [("user", "p")]]


def test_failing_row_gives_null_and_spares_the_rest(spark):
    table = spark.createDataFrame([(1, "hello"), (2, "fail"), (3, "world")], "n int, text string").coalesce(1)
    asked = table.withColumn("messages", F.when(F.col("n") != 3, g.chat_messages(F.col("text"))))
    got = {r.n: r.answer for r in g.generate(asked, "messages", backend(), "answer", model="m", max_tokens=5).collect()}
    assert got == {1: "m/5/1: hello", 2: None, 3: None}


def test_backend_that_cannot_start_gives_null(spark):
    def make(model=None, **options):
        raise ValueError("no key")

    queries = spark.createDataFrame([(1, "query")], "query_id int, query string")
    assert g.rewrite_queries(queries, make).first().enhanced == "query"
    assert g.rewrite_queries(queries, None).first().enhanced == "query"


def test_summary_prompt(spark):
    pages = spark.createDataFrame([(1, "x" * 3000), (2, "")], "n int, text string")
    prompt = {r.n: r.p for r in pages.select("n", g.summary_prompt(F.col("text")).alias("p")).collect()}
    assert prompt[1] == g.SUMMARY_PROMPT + "x" * 2000 and prompt[2] is None
    got = {r.n: r.llm_summary for r in g.with_summary(pages, backend(), "m").collect()}
    assert got == {1: "m/150/1: xxxxx", 2: None}
    assert {r.llm_summary for r in g.with_summary(pages, backend(), enabled=False).collect()} == {None}


def test_rewrite_falls_back(spark):
    rows = [("q", "enhanced query"), ("q", None), ("q", "   "), ("Query", " query \n"), ("q", "　better\t")]
    table = spark.createDataFrame(rows, "query string, answer string")
    got = [r[0] for r in table.select(g.rewritten_or_original(F.col("query"), F.col("answer"))).collect()]
    assert got == ["enhanced query", "q", "q", "Query", "better"]


def test_seed_file(spark, tmp_path):
    path = tmp_path / "seeds.txt"
    path.write_text("  http://a/\n\n\thttp://b/ \n   \nhttp://a/\n", encoding="utf-8")
    got = [tuple(r) for r in read_seeds(spark, str(path)).orderBy("pos").collect()]
    assert got == [("http://a/", 0, 1), ("http://b/", 0, 2), ("http://a/", 0, 3)]


def test_equal_prompts_are_asked_once_and_answers_stay(spark):
    def make(model=None, **options):
        import uuid

        return lambda batch: [uuid.uuid4().hex for _ in batch]

    table = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, "")], "n int, text string")
    summarised = g.with_summary(table, make)
    first, second = ({r.n: r.llm_summary for r in summarised.collect()} for _ in range(2))
    assert first == second and first[1] == first[2] != first[3] and first[4] is None
    plan = g.generate(table.withColumn("m", g.chat_messages(F.col("text"))), "m", make, "a")._jdf.queryExecution()
    assert "Python" not in plan.executedPlan().toString() and "MapInPandas" not in plan.executedPlan().toString()
