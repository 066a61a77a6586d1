import random

import pyarrow.parquet as pq

from spanledger.llm.decontaminate import answer_words, contaminations, decontaminated, lcs_length
from spanledger.llm.queries import QUERIES
from tests.llm.brute import lower, words

SF = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs():
    rnd = random.Random(3)
    for _ in range(60):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(30))] for _ in range(2))
        assert lcs_length(a, b) == plain_lcs(a, b)


def test_verbatim_items_on_the_whole_table(spark):
    """Recall against brute force: texts that hold all words of an item in a row."""
    texts = {d["doc_id"]: " " + " ".join(words(lower(d["text"] or ""))) + " " for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    items = {b["item_id"]: " " + " ".join(words(lower(b["text"]))) + " " for b in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    want = {d for d, t in texts.items() if any(i in t for i in items.values())}
    rows = QUERIES["op6_decontamination"](spark, SF).collect()
    got = {r.doc_id for r in rows if r.contaminated}
    print(len(want), len(got), len(got - want))
    assert len(rows) == len(texts) and want and want <= got and len(got - want) <= 2


def test_paraphrases_and_clean_texts(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(20)]
    docs = []
    for i in range(200):
        own = [word() for _ in range(120)]
        if i < 60:
            copy = items[i % 20][1].split()
            for _ in range(7):
                copy[rnd.randrange(len(copy))] = word()
            at = rnd.randrange(len(own))
            own[at:at] = copy
        docs.append((i, " ".join(own)))
    found = contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    hit = {(r.doc_id, r.item_id) for r in found}
    assert len(hit & {(i, i % 20) for i in range(60)}) >= 54 and hit <= {(i, i % 20) for i in range(60)}


def test_every_item_has_a_part_in_the_basis(spark):
    """1,200 items of 38 words have more passages than were once fitted; all are planted verbatim."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(38))) for i in range(1200)]
    docs = [(i, " ".join([word() for _ in range(30)] + [text] + [word() for _ in range(30)])) for i, text in items]
    found = contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(1200)}


def held(text, item):
    """The greatest LCS of any place of the text with the item that counts, by comparing all places; 0 for none."""
    words, own, best = text.lower().split(), item.lower().split(), 0
    k = answer_words(item)
    for begin in range(0, len(words), 16):
        around = words[max(begin - len(own), 0):begin + 32 + len(own)]
        share = lcs_length(own, around) / len(own)
        answer = k >= 4 and any(around[i:i + k] == own[-k:] for i in range(len(around)))
        best = max(best, share if share >= 0.6 or share >= 0.45 and answer else 0)
    return best


def test_short_long_and_edited_items_against_all_places(spark):
    """Recall and precision against an exhaustive LCS: items of 15 to 300 words, whole, thinned or spread, in one vocabulary."""
    rnd = random.Random(17)
    vocabulary = ["".join(rnd.choice("abcdefghijk") for _ in range(5)) for _ in range(500)]
    word = lambda: vocabulary[int(500 * rnd.random() ** 2)]
    items = []
    for i in range(40):
        n = (15, 16, 17, 38, 120, 300)[i % 6]
        items.append((i, " ".join(word() for _ in range(n - 6)) + ". " + " ".join(word() for _ in range(6)) + "."))
    docs = []
    for i in range(160):
        own, copy = [word() for _ in range(rnd.choice((20, 150, 400)))], items[i % 40][1].split()
        keep = (1, 0.75, 0.62, 0.5)[i // 40]
        body = [w if rnd.random() < keep else word() for w in copy[:-6]]
        if i % 3 == 0:
            body = [w for x in body for w in ((x, word()) if rnd.random() < 0.3 else (x,))]
        at = rnd.randrange(len(own))
        own[at:at] = body + copy[-6:]
        docs.append((i, " ".join(own)))
    want = {(d, i): x for d, text in docs for i, item in items if (x := held(text, item))}
    found = contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    print(len(want), len(want.keys() & {(r.doc_id, r.item_id) for r in found}))
    assert len(want) > 80 and {(r.doc_id, r.item_id): round(r.lcs, 6) for r in found} == {k: round(x, 6) for k, x in want.items()}


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore"
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, long, 1), (3, long, 1), (4, "x y z " * 30000 + long.upper(), 1), (None, "q", 1)],
                               "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, long), (1, long), (2, None), (3, " "), (None, "short text")], "item_id long, text string")
    rows = decontaminated(df, items).collect()
    assert len(rows) == 6 and {r.doc_id for r in rows if r.contaminated} == {3, 4}
    assert not any(r.contaminated for r in decontaminated(df, items.limit(0)).collect())
    assert decontaminated(df.limit(0), items).collect() == []
