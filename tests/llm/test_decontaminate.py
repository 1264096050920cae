"""Template decontamination against brute force, and what it must and must not find."""

import itertools
import re

from prospectra.llm import decontaminate as D

ITEMS = [
    (1, "A farmer named Alice has 12 apples and gives 5 kg of them to her brother before walking home again in the rain."),
    (2, "Why do rivers bend so often when they cross a wide and very flat plain of sand and clay today?"),
    (3, "what is the tallest tree"),
    (4, "Paris London Rome Berlin Madrid Vienna Prague Oslo Cairo Lima Quito Delhi Tokyo Seoul"),
    (5, None),
    (6, "no"),
]


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect())


def test_verbatim_reparameterised_and_clean(spark):
    texts = [
        f"Some words before. {ITEMS[0][1]} And after.",
        "xx A farmer named Robert has 77 apples and gives 31 kg of them to her brother before walking home again in the rain.",
        "xx A farmer named Robert has 77 apples and gives 31 kg to his uncle while the dog sleeps on.",
        "the rivers bend so often when they cross a wide and very flat land",
        "and what is the tallest tree in town",
        "Paris London Rome Berlin Madrid Vienna Prague Oslo Cairo Lima Quito Delhi Tokyo Seoul",
        None,
        "",
        "no",
        "word " * 2000 + ITEMS[1][1].upper().lower(),
    ]
    texts.append("!! ".join(ITEMS[1][1].upper().split()))
    texts.append(ITEMS[3][1].lower() + " and more")
    assert found(spark, texts) == [(0, 1), (1, 1), (4, 3), (5, 4), (8, 6), (9, 2), (10, 2), (11, 4)]


def test_slots_must_stand_for_one_value_each(spark):
    item = [(1, "if 7 boxes hold 7 balls then how many balls will 9 hold")]
    good = "if 3 boxes hold 3 balls then how many balls will 4 hold"
    bad = "if 3 boxes hold 5 balls then how many balls will 4 hold"
    assert found(spark, [good, bad], item) == [(0, 1)]


def test_copies_with_runs_of_numbers(spark):
    items = [
        (1, "Sort 9 4 7 1 3 in ascending order"),
        (2, "Compute 12 + 7 * 3 - 4 / 2"),
        (3, "Which number comes next after all of these: 2, 4, 8, 16, 32, 64"),
        (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
    ]
    texts = [f"well then 5 {t} and so on" for _, t in items]
    texts += ["sort 9 4 7 1 2 in ascending order", "compute 12 + 7 * 3 - 4 / 3", "2 3 4 5 6 7 8 9 10 11 12 13", "x " * 7 + items[3][1]]
    assert found(spark, texts, items) == [(0, 1), (1, 2), (2, 3), (3, 4), (7, 4)]


def test_scripts_without_spaces(spark):
    items = [(1, "世界上最高的山峰叫什么名字"), (2, "ประเทศไทยมีกี่จังหวัด"), (3, "日本の首都はどこですか")]
    texts = ["请问" + items[0][1] + "呢", "x" + items[1][1], items[2][1], "世界上最长的河流叫什么名字"]
    assert found(spark, texts, items) == [(0, 1), (1, 2), (2, 3)]


def test_items_of_few_tokens(spark):
    items = [(1, "no"), (2, "Name 3"), (3, "capital of Peru"), (4, "how old is Bob")]
    texts = ["No", "no way", "x no", "name 3", "name 4", "the capital of peru is big", "capital of Chile", "So how old is bob now", "how old is Ann", "NO! no"]
    assert found(spark, texts, items) == [(0, 1), (3, 2), (5, 3), (7, 4)]


def brute(texts, items):
    token = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[%$€£]")

    def read(text, named):
        raw = token.findall(text or "")
        kind = ["N" if t[0].isdigit() else "U" if t.lower() in D.UNITS else "P" if named and t != t.lower() else t.lower() for t in raw]
        return kind, [k + t.lower() if k in "NUP" and len(k) == 1 else k for k, t in zip(kind, raw, strict=True)]

    slots = {"N", "U", "P"}
    out = []
    for (i, text), named in itertools.product(items, (True, False)):
        b, bv = read(text, named)
        n = min(len(b), D.SPAN)
        if not b:
            continue
        for k, t in enumerate(texts):
            d, dv = read(t, named)
            hit = False
            for x in range(len(b) - n + 1):
                literal = n < D.SHORTEST or any(all(s in slots for s in b[x + j : x + j + D.GRAM]) for j in range(n - D.GRAM + 1))
                for y in range(len(d) - n + 1):
                    if literal:
                        hit |= bv[x : x + n] == dv[y : y + n] and (n >= D.IN_TEXT or len(d) == n)
                    elif b[x : x + n] == d[y : y + n]:
                        pairs = set(zip(bv[x : x + n], dv[y : y + n], strict=True))
                        hit |= len(pairs) == len(set(bv[x : x + n])) == len(set(dv[y : y + n]))
            if hit:
                out.append((k, i))
    return sorted(set(out))


def test_equals_brute_force_on_random_text(spark):
    import random

    rng = random.Random(3)
    words = ["aa", "bb", "cc", "Dd", "Ee", "1", "22", "kg", "ff", "gg"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 13, 20, 40]))) for k in range(25)]
    texts = []
    for _ in range(60):
        a = items[rng.randrange(25)][1].split()
        cut = a[rng.randrange(3) :][: rng.randint(4, 30)]
        texts.append(" ".join([prose(rng.randint(0, 30)), *cut, prose(rng.randint(0, 30))]))
    assert found(spark, texts, items) == brute(texts, items)


def test_nothing_in_nothing(spark):
    assert found(spark, [], ITEMS) == []
    assert found(spark, ["some text of a few words"], []) == []


def test_drop_keeps_clean_rows(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], "b"), (2, "clean", "c"), (None, "no id", "d"), (None, ITEMS[1][1], "e"), (None, None, "f"), (3, None, "g"), (1, "clean too", "h")], "doc_id long, text string, bad_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = D.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.bad_id for r in left.collect()) == ["c", "d", "f", "g"]
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 7 and D.drop_contaminated(docs.limit(0), bench).collect() == []


def rows_made(df):
    """The most rows that a join of the plan that ran has made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().get("numOutputRows").get().value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


def test_a_common_phrase_makes_no_pairs(spark):
    phrase = "which of the following is the best answer"
    words = lambda k, n: " ".join(f"{'abcdefghij'[(k * 7 + i) % 10]}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + i)}" for i in range(n))
    items = [(k, f"{words(k, 9)} {phrase} {words(k + 1000, 9)}") for k in range(600)]
    docs = spark.createDataFrame([(k, f"{words(k + 5000, 13)} {phrase} {words(k + 9000, 8 + k % 7)}") for k in range(600)] + [(999, items[5][1])], "doc_id long, text string")
    got = D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_made(got) <= 601 * 4
    assert [tuple(r)[:2] for r in got.collect()] == [(999, 5)]


def test_one_bad_id_is_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(k, ITEMS[1][1] if k == 3 else f"clean words {k}") for k in range(50)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    left = D.drop_contaminated(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(ITEMS, "item_id long, text string"))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert left.count() == 49 and "BroadcastHashJoin" in plan and "LeftAnti" in plan and "hashpartitioning" not in plan
