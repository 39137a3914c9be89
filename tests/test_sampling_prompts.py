import collections

import pytest
from pyspark.sql import functions as F

from labelspark.operators import infer as I
from labelspark.operators import prompt as P
from labelspark.operators import sample as S

TEMPLATE = "T\n<types>\n- a\n- b\n- c\n- {{d}}\n</types>\n<styles>\n- x\n- y\n- z\n</styles>\n{labels}"


@pytest.fixture
def freqs(table):
    return table([("A", 8.0), ("B", 1.0), ("C", 1.0), ("Z", 0.0)], "code string, freq double")


@pytest.fixture
def ids(spark):
    return spark.range(0, 3000, 1, 5).withColumnRenamed("id", "row_id")


def by_row(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["row_id"], r["pos"])):
        out[r["row_id"]].append(r["code"])
    return out


def test_weighted_sample(ids, freqs):
    got = by_row(S.sample_codes(ids, "row_id", freqs, "1"))
    assert len(got) == 3000
    assert all(len(set(codes)) == len(codes) <= 3 and "Z" not in codes for codes in got.values())
    # sizes 1..5, but only three codes can be drawn
    sizes = collections.Counter(len(c) for c in got.values())
    assert set(sizes) == {1, 2, 3} and sizes[3] > 1500
    firsts = collections.Counter(c[0] for c in got.values())
    assert abs(firsts["A"] / 3000 - 0.8) < 0.03
    # after A, the others are equally likely
    second = collections.Counter(c[1] for c in got.values() if len(c) > 1 and c[0] == "A")
    assert abs(second["B"] / sum(second.values()) - 0.5) < 0.05


def test_sample_is_repeatable(ids, freqs):
    one = by_row(S.sample_codes(ids.coalesce(1), "row_id", freqs, "1"))
    assert one == by_row(S.sample_codes(ids.repartition(9), "row_id", freqs, "1"))
    assert one != by_row(S.sample_codes(ids, "row_id", freqs, "2"))


def test_later_rounds_fill_short_rows(ids, table, monkeypatch):
    skewed = table([("A", 97.0), ("B", 1.0), ("C", 2.0)], "code string, freq double")
    got = by_row(S.sample_codes(ids, "row_id", skewed, "1", max_labels=2))
    sizes = collections.Counter(len(c) for c in got.values())
    assert len(got) == 3000 and set(sizes) == {1, 2} and 1300 < sizes[2] < 1700


def test_even_sample(ids, freqs):
    got = by_row(S.sample_codes(ids, "row_id", freqs, "1", weighted=False))
    firsts = collections.Counter(c[0] for c in got.values())
    assert set(firsts) == {"A", "B", "C", "Z"} and all(abs(n / 3000 - 0.25) < 0.03 for n in firsts.values())


def test_many_codes_share_cells(spark, ids):
    many = spark.range(20_000).select(F.format_string("c%05d", "id").alias("code"), F.lit(1.0).alias("freq"))
    got = by_row(S.sample_codes(ids, "row_id", many, "3"))
    assert len(got) == 3000 and {len(c) for c in got.values()} == {1, 2, 3, 4, 5}
    everything = [int(c[1:]) for codes in got.values() for c in codes]
    assert abs(sum(everything) / len(everything) / 10_000 - 1) < 0.05


def test_no_code_to_draw(ids, table):
    with pytest.raises(ValueError):
        S.sample_codes(ids, "row_id", table([("A", 0.0)], "code string, freq double"))


def test_items_and_template(ids):
    template, fields = P.sampled_template(TEMPLATE, "row_id")
    assert template == "T\n{types}\n{styles}\n{labels}"
    rows = ids.select(fields["types"].alias("t"), fields["styles"].alias("s")).collect()
    types = collections.Counter(i for r in rows for i in r["t"].split("\n"))
    assert set(types) == {"- a", "- b", "- c", "- {d}"} and all(abs(n / 3000 - 0.75) < 0.04 for n in types.values())
    assert all(sorted(r["s"].split("\n")) == ["- x", "- y", "- z"] for r in rows)
    with pytest.raises(ValueError):
        P.sampled_template("no block", "row_id")


def test_prompts(table, rows_of):
    codes = table([("B", "beta", 0), ("A", "alpha", 1)], "code string, description string, ord int")
    df = table([(1, "x {y}", ["A", "B", "A"]), (2, "z", [])], "row_id int, text string, labels array<string>")
    label = P.labelling_prompts(df, codes, "{context}|{input_text}")
    assert rows_of(label.select("row_id", "pre_query_str")) == [(1, "B: beta\nA: alpha|x {y}"), (2, "B: beta\nA: alpha|z")]
    verify = P.verification_prompts(df, "row_id", codes, "{input_text}|{labels}")
    assert rows_of(verify.select("row_id", "pre_query_str")) == [(1, "x {y}|A: alpha\nB: beta\nA: alpha"), (2, "z|")]
    with pytest.raises(Exception, match="without description: A"):
        P.described_labels(df, "row_id", codes.filter("code = 'B'")).collect()


def test_context_can_have_a_limit(table):
    codes = table([("B", "beta", 0)], "code string, description string, ord int")
    with pytest.raises(ValueError):
        P.context_text(codes, max_chars=5)


def test_document_prompts(ids, table):
    codes = table([("A", "alpha"), ("B", "beta")], "code string, description string")
    freqs = table([("A", 1.0), ("B", 3.0)], "code string, freq double")
    rows = P.document_prompts(ids, "row_id", codes, freqs, TEMPLATE).collect()
    assert len(rows) == 3000
    names = {"A": "A: alpha", "B": "B: beta"}
    assert all(r["pre_query_str"].endswith("\n".join(names[c] for c in r["labels"])) for r in rows)


def test_scoring_and_generation(spark, table, rows_of):
    df = table([(i, "x" * i) for i in range(70)], "row_id int, text string")

    def load():
        return lambda texts: [[len(t) / 100, 0.5] for t in texts]

    scored = I.score_texts(df, load, batch_size=16)
    assert rows_of(scored)[69] == (69, "x" * 69, [0.69, 0.5]) and scored.count() == 70

    def client():
        return lambda prompts: [f" got {p} \n" for p in prompts]

    prompts = df.withColumn("pre_query_str", F.col("text"))
    out = I.generate_texts(prompts, client, I.Decoding("m", temperature=0.7), batch_size=7, chat=lambda p: f"<{p}>")
    row = out.filter("row_id = 2").first()
    assert row["output"] == "got <xx>" and "pre_query_str" not in out.columns
    assert row["gen_configs"].asDict() == {
        "prompt": "<xx>", "temperature": 0.7, "top_p": 1.0, "repetition_penalty": 1.0, "max_tokens": 4096, "model": "m"
    }


def test_very_uneven_weights_end(ids, table):
    freqs = table([("a", 1.0), ("b", 1e-20), ("c", 1e-30)], "code string, freq double")
    got = S.sample_codes(ids, "row_id", freqs, "1").groupBy("row_id").agg(F.collect_list("code").alias("cs")).collect()
    assert len(got) == 3000 and all(len(set(r.cs)) == len(r.cs) for r in got)
    assert {len(r.cs) for r in got} == {1, 2, 3}


def test_draws_follow_successive_sampling(ids, table):
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 1.0}
    freqs = table(list(weights.items()), "code string, freq double")
    drawn = S.sample_codes(ids, "row_id", freqs, "2").orderBy("row_id", "pos").collect()
    rows = {}
    for r in drawn:
        rows.setdefault(r.row_id, []).append(r.code)
    pairs = [tuple(c[:2]) for c in rows.values() if len(c) > 1]
    chi = 0.0
    for x in weights:
        for y in set(weights) - {x}:
            want = len(pairs) * weights[x] / 10 * weights[y] / (10 - weights[x])
            chi += (pairs.count((x, y)) - want) ** 2 / want
    assert len(pairs) > 1500 and chi < 31.3  # 11 degrees of freedom, one in a thousand


def test_prompts_filled_in_the_task_are_those_of_the_columns(spark):
    from labelspark.operators import infer as I
    from labelspark.operators import prompt as Q

    codes = spark.createDataFrame([("B", "beta {x}", 1), ("A", "alpha", 0), ("C", None, 2)], "code string, description string, ord int")
    rows = spark.createDataFrame([(1, "one {context} }}"), (2, ""), (3, "two\nlines")], "row_id int, text string").repartition(2)
    template = "{{codes}}\n{context}\n--\n{input_text} and {input_text}"
    value = Q.context_value(codes)
    assert value == "A: alpha\nB: beta {x}"
    sent = []

    def load():
        return lambda prompts: [f" {len(p)}|{p} " for p in prompts]

    want = Q.labelling_prompts(rows, codes, template)
    whole = I.generate_texts(want, load, I.Decoding("m"))
    found = I.generate_filled(rows, load, I.Decoding("m"), template, constants={"context": value})
    read = lambda df: sorted((r.row_id, r.text, r.output, *r.gen_configs) for r in df.collect())
    assert read(found) == read(whole) and not sent
    # only the rows' own columns go to Python
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "beta" not in plan.split("MapInPandas")[-1]
    with pytest.raises(ValueError):
        Q.context_value(codes, max_chars=5)


def test_generation_passes_other_columns_as_they_are(spark):
    """Slices of Arrow batches go to the model; an integer beside a null stays one."""
    rows = [(i, f"text {i}", None if i % 3 else 2**53 + i) for i in range(20)]
    frame = spark.createDataFrame(rows, "row_id long, pre_query_str string, own long").coalesce(1)

    def load():
        def run(prompts):
            return [f" {len(prompts)} " for _ in prompts]

        return run

    out = I.generate_texts(frame, load, I.Decoding("m"), batch_size=8).collect()
    assert sorted((r["row_id"], r["own"]) for r in out) == [(i, own) for i, _, own in rows]
    assert max(int(r["output"]) for r in out) == 8 and all(r["gen_configs"]["prompt"] == f"text {r['row_id']}" for r in out)
