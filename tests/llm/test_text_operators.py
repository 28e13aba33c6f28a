"""Text operators against brute force, with odd rows: null, empty, long, tied, repeated."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetloom.llm import (
    alignment, causal_lm, chat, forest, identifiers, packing, page_text, queries, ranking, rules, units,
)
from packetloom.llm.common import WordHashes, prepare, sliced
from packetloom.llm.graph import components
from packetloom.llm.text_stats import COUNTS, RATES, measure

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF_DIR = "/root/testdata/sf0.001"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["ta", "mo", "ri", "ke"]) + rng.choice(["ln", "rs", "th", "ve"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    base = prose(1, 120).split()
    near = [*base[:60], "changed", *base[61:]]
    return [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, " \t\n"),
        (7, "one two"), (8, "One  TWO"), (9, prose(9, 3000)), (9, prose(9, 3000)), (10, prose(10, 80)), (None, prose(11, 60)),
        (None, None), (12, "mail a.b@c.org now +1 (555) 010-2030 x 10.1.2.3 y 4111 1111 1111 1111"),
        (13, "x" * 20000), (14, "1 2 " * 5000), (15, "naïve café ÀÉ …   \x1c end"),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_texts):
    prepare(spark)
    rows = [(i, t, None, "s", len(t) if t else None) for i, t in odd_texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    words = SPACES.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def classes(rows):
    """Brute force: smallest id reachable over links of at least 75 percent."""
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y) and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for group in range(12):
        words = prose(group, 150).split()
        for copy in range(group + 1):
            changed = list(words)
            for _ in range(copy % 6):
                changed[rng.randrange(len(changed))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in forest.near_duplicates(df).collect()}
    want = classes(rows)
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert all(found[i]["n_shingles"] == len(shingles(t)) and found[i]["kept"] == (want[i] == i) for i, t in rows)


def test_near_duplicates_of_large_regions(spark, monkeypatch):
    """Partners among many sets that share most shingles with all: in slices of their regions they would not meet."""
    monkeypatch.setattr(forest, "REGION", 4)
    rng, shared, rows = random.Random(11), [f"w{k}" for k in range(184)], []
    places = rng.sample(range(1000), 160)
    for k in range(160):
        own = [f"o{k}x{j}" for j in range(rng.randrange(24, 29))]
        rows.append((places[k], " ".join([*shared, *[f"p{k // 2}x{j}" for j in range(10)], *own])))
    want = classes(rows)
    assert sum(v < k for k, v in want.items()) == 80
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(df, nearest=1).collect()} == want


def test_large_region_of_copies(spark):
    """More near copies of one text than a region holds are still one class."""
    words, rng = prose(3, 100).split(), random.Random(1)
    rows = [(0, " ".join(words))]
    for i in range(1, 700):
        changed = list(words)
        changed[rng.randrange(100)] = f"w{i}"
        rows.append((i, " ".join(changed)))
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.select("component_id").distinct().collect() == [(0,)]


def test_refused_candidates_hide_no_link(spark):
    """Two texts at just 75 percent, each among texts of one template that lie nearer by sketch but under it."""
    words, rng, new = prose(8, 704).split(), random.Random(6), iter(range(10**6))

    def edited(base, places):
        changed = list(base)
        for place in places:
            changed[place] = f"new{next(new)}"
        return changed

    def spread(n):
        at = list(range(6, 696, 6))
        return rng.sample(at, n)

    other = edited(words, spread(20))
    texts = [words, other, *[edited(base, spread(21)) for base in (words, other) for _ in range(60)]]
    rows = [(k, " ".join(text)) for k, text in enumerate(texts)]
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == classes(rows)
    assert classes(rows)[1] == 0


def test_bins_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for size in (5, 300, 3000, 90_000):
        one, two = (np.unique(rng.integers(0, 1 << 63, size, np.uint64) << np.uint64(1)) for _ in range(2))
        two = np.union1d(one[: size // 2], two[: size // 2])
        left, right = forest.bins(one), forest.bins(two)
        assert bool(left) == (size < 90_000)
        if left and right:
            shared = np.minimum(np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)).sum(dtype=np.int64)
            assert shared >= len(np.intersect1d(one, two))


def test_near_duplicates_odd_rows(odd, none):
    rows = [tuple(r) for r in forest.near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    by_id = {r[0]: r[1:] for r in rows if r[0] is not None}
    assert by_id[1][1] == by_id[3][1] == by_id[2][1] == 1 and not by_id[2][2]
    assert by_id[4] == by_id[5][:1] + (4, True) and by_id[5] == by_id[6][:1] + (5, True)
    assert by_id[7] == (1, 7, True) and by_id[8] == (1, 7, False)
    assert all(r[2] is None and r[3] for r in rows if r[0] is None)
    assert forest.near_duplicates(none).count() == 0
    kept = forest.one_of_each(odd.withColumn("component", F.lit(1)).withColumn("__gone", F.lit(2)))
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 9, 10, 12, 13, 14, 15]
    assert kept.columns == [*odd.columns, "component", "__gone"]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901)], "a bigint, b bigint")
    assert dict(components(links).groupBy("component").count().collect()) == {0: 301, 900: 2}


def test_signature_estimates_similarity():
    cache = WordHashes()
    one = prose(1, 400)
    words = one.split()
    two = " ".join([*words[:370], *prose(2, 30).split()])
    x, y = forest.shingle_set(one, cache), forest.shingle_set(two, cache)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    a, b = forest.signature(x), forest.signature(y)
    assert abs((a == b).mean() - true) < 0.15
    away = forest.apart(np.frombuffer(forest.sketch(a), np.uint64)[None], np.frombuffer(forest.sketch(b), np.uint64)[None])
    assert away[0] <= forest.MOST_APART


def brute_stats(text):
    text = text or ""
    words = SPACES.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACES.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)]


@pytest.mark.parametrize("text", [
    None, "", "a", "a a a a", "a b c a b c", "x#y $\n\nx#y $\nx#y $ ", "é à b\x1cc d", "a\tb\x0bc\x0cd\re", prose(4, 400) + "\n" + prose(4, 30),
])
def test_statistics(text):
    assert measure(text or "")[0] == brute_stats(text)


def test_rules_of_the_tables(spark):
    got = queries.op8_quality_rules(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for row in got.join(docs.select("doc_id", "text"), "doc_id").collect():
        want = brute_stats(row["text"])
        assert [row[c] for c in COUNTS] == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row["base_failed"] and row["kept"])


def test_learned_rules():
    import pandas as pd

    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.random((3000, len(RATES))), columns=list(RATES))
    bad = ((data["bang_rate"] > 0.8) | ((data["symbol_rate"] > 0.7) & (data["upper_rate"] <= 0.5))).to_numpy()
    learned = rules.learn(data, bad)
    hit = np.zeros(len(data), bool)
    for rule in learned:
        hit |= rules.covers(rule, data)
    assert 2 <= len(learned) and (hit == bad).mean() > 0.95
    assert rules.learn(data[:0], bad[:0]) == [] and rules.learn(data, np.zeros(3000, bool)) == []


def test_rules_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id bigint, quality int")
    learned = rules.learn_from(odd, labels)
    assert rules.judge(odd, learned).count() == odd.count()
    wide = odd.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(0))
    assert rules.passing(wide, learned).columns == wide.columns
    assert rules.passing(none, rules.learn_from(none, labels.limit(0))).count() == 0


def test_ranking_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_quality_ranking(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for _, r in got.iterrows())


def test_ranking_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1)], "doc_id bigint, quality int")
    ranker = ranking.learn_from(odd, labels)
    scored = ranking.score(odd.withColumn("score", F.lit("x")), ranker).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert ranking.score(none, ranking.learn_from(none, labels)).count() == 0


def test_chunks_give_the_ids_of_the_text(odd_texts):
    whole = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    odd = [t for _, t in odd_texts if t] + [
        "a  b", "  a", "a ", "x\n y", "x \ny", "x\n  y ", "it's  \t ok", "<|endoftext|> b<|endoftext|>", "日本語 テスト", "a\r\n b",
    ]
    for limit in (10**6, 3):
        coder = packing.ChunkIds(packing.TOKENIZER, limit=limit)
        for _ in range(2):
            for text, ids in zip(odd, coder.texts(odd, at_once=4), strict=True):
                assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing(odd, none):
    whole = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    rows = packing.pack(odd, capacity=256).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    texts = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    want = Counter()
    for (doc, text), times in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 256 or min(256, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (b, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, b, e - b, zlib.crc32(ids[b:e].tobytes())] += times
    assert Counter(tuple(r)[:5] for r in rows) == want
    counts = np.bincount([r["length"] for r in rows], minlength=257)
    assert len(by_sequence) <= packing.bound(counts, 256) + 1
    assert packing.pack(none).count() == 0


def test_completions_are_exact_on_small_rooms():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randrange(1, 12) for _ in range(6)]
        counts = np.bincount(sizes, minlength=31)
        best = max(
            sum(s for k, s in enumerate(sizes) if mask >> k & 1) for mask in range(64)
            if sum(s for k, s in enumerate(sizes) if mask >> k & 1) <= 20
        )
        got = packing.completions(20, counts.copy())
        assert all(not (Counter(f) - Counter(sizes)) and sum(f) <= 20 for f in got)
        assert sum(got[0]) >= best - 1
    counts = np.bincount([6] * 5 + [4] * 5 + [7, 3], minlength=11)
    assert packing.solve(counts, 10).sequences == packing.bound(counts, 10) == 6


def fewest(sizes: list[int], capacity: int) -> int:
    """The optimum, over all subsets: fewest sequences, then least fill of the last one."""
    best = [(1, 0)] * (1 << len(sizes))
    for mask in range(1, len(best)):
        tries = []
        for k, size in enumerate(sizes):
            if mask >> k & 1:
                n, fill = best[mask ^ 1 << k]
                tries.append((n, fill + size) if fill + size <= capacity else (n + 1, size))
        best[mask] = min(tries)
    return best[-1][0]


def test_branch_and_bound_is_exact_on_small_tables():
    rng, above = random.Random(3), 0
    for turn in range(240):
        capacity = rng.choice([20, 37, 60, 100])
        low, high = [(1, 2 * capacity // 3), (capacity // 5, 2 * capacity // 3), (capacity // 4, capacity // 2)][turn % 3]
        sizes = [rng.randint(low, high) for _ in range(rng.randint(1, 11))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        plan = packing.solve(counts.copy(), capacity)
        assert all(sum(filling) <= capacity for filling, _ in plan.fillings)
        used = Counter()
        for filling, times in plan.fillings:
            used.update({size: n * times for size, n in Counter(filling).items()})
        assert used == Counter(sizes)
        assert plan.sequences == fewest(sizes, capacity)
        above += plan.sequences > packing.bound(counts, capacity)
    assert above
    assert packing.solve(np.zeros(11, np.int64), 10).sequences == 0


def test_undominated_fillings():
    counts = np.bincount([7, 5, 4, 3, 2, 2], minlength=11)
    found = set(packing.undominated(9, counts, [1000]))
    assert found == {(7, 2), (5, 4)}
    assert packing.dominated((4, 3, 2), 0, np.bincount([7], minlength=11))
    assert not packing.dominated((7, 2), 0, np.bincount([5, 4], minlength=11))


def test_long_sets_are_compared_as_pairs(spark, monkeypatch):
    """Whatever the size from which sets are compared as pairs, the components are the same."""
    words, rng = prose(4, 200).split(), random.Random(2)
    rows = []
    for k in range(40):
        changed = list(words)
        for _ in range(k % 12):
            changed[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
        rows.append((k, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = classes(rows)
    for long in (1, 190, 10**6):
        monkeypatch.setattr(forest, "LONG", long)
        assert {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(df, nearest=1).collect()} == want


PAGE = """<html><head><title>No</title><script>var a="<p>no</p>";</script></head><body class="home"><header>no</header>
<nav><a href="/">no</a></nav><div class="cookie-notice">no</div><div id="sidebar">no<p>no</p></div>
<div class="post p12"><h1>Title &amp; more</h1><p>First   part<br>goes on<p>Second<b> bold</b> one</p><form>no</form>
<ul><li>item<li>other</ul><div class="ad">no</div></div><section class="comments"><p>no</p></section><footer>no</footer></body></html>"""


def test_page_text(spark):
    prepare(spark)
    rows = [
        (1, "http://Host.example/a", PAGE), (2, "http://host.example/b", PAGE.replace("p12", "p7")), (3, None, None), (4, "x", ""),
        (5, "http://host.example/c", "<div class='other'><p>lonely text"), (1, "http://Host.example/a", PAGE), (None, None, "plain &lt; text <p"),
    ]
    got = page_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)))
    want = "Title & more\n\nFirst part goes on\n\nSecond bold one\n\nitem\n\nother"
    by_id = {r["page_id"]: r for r in got.collect()}
    assert got.count() == 7 and by_id[1]["text"] == by_id[2]["text"] == want and by_id[1]["n_chars"] == len(want)
    assert by_id[3]["text"] == by_id[4]["text"] == "" and by_id[5]["text"] == "lonely text" and by_id[None]["text"] == "plain < text"
    assert page_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_host_paths_agree(spark):
    rows = [("h", PAGE)] * 3 + [("h", "<body><main><p>" + "word " * 50)]
    paths = page_text.host_paths(spark.createDataFrame(rows, "host string, html string")).collect()
    assert paths == [("h", "body.home/div.p#.post")]


def brute_repeats(rows, min_words):
    first, out = {}, []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        at = 0
        for line in (text or "").split("\n"):
            words = tuple(units.normal_form(line))
            if len(words) >= min_words and first.setdefault(words, (doc, at)) != (doc, at):
                out.append((doc, at, at + len(line), *first[words]))
            at += len(line) + 1
    return out


def test_repeated_lines(spark, none):
    prepare(spark)
    line = prose(1, 9)
    rows = [(3, f"a\n{line}\nb"), (1, f"{line.upper()}."), (2, f"{line}\n{line}"), (4, None), (5, ""), (3, f"a\n{line}\nb"), (None, line)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = units.repeats(df, min_words=8)
    assert sorted(set(tuple(r)[:3] + tuple(r)[4:] for r in got.collect())) == sorted(brute_repeats(rows, 8))
    left = {r["doc_id"]: r for r in units.without_repeats(df, min_words=8).collect()}
    assert left[3]["text"] == "a\nb" and left[2]["text"] == "" and left[1]["text"] == "" and left[4]["text"] is None
    assert [tuple(s) for s in left[3]["removed"]] == [(2, 2 + len(line))]
    assert units.repeats(none).count() == 0
    paragraph = list(units.cut("a\nb\n\n \nc", "paragraph"))
    assert paragraph == [(0, 3), (7, 8)]


def test_short_lines_repeat_too(spark):
    """Repeated lines of one to seven words are found without a parameter."""
    prepare(spark)
    rows = [(k, f"{prose(100 + k, 12)}\n{prose(7, k % 7 + 1)}\n{prose(200 + k, 3)}\n...") for k in range(21)]
    got = units.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute_repeats(rows, 1)
    assert len(want) == 14 and sorted((r["doc_id"], r["begin"], r["end"], r["first_doc_id"], r["first_begin"]) for r in got) == sorted(want)


def test_repeated_sentences_inside_lines(spark):
    """A passage that begins and ends inside lines is removed by its sentences, a chance pair of short ones is not."""
    prepare(spark)
    one, two = prose(31, 30) + ".", prose(32, 28) + "!"
    rows = [
        (1, f"Own start here. {one} {two} Own end."), (2, f"x\nOther words. {one.upper()} {two}\ny"), (3, f"{one}\nz"),
        (4, "By chance. Left."), (5, "By chance. Right."), (6, "Once more. Up."), (7, "Once more. Down."), (8, "Once more. In."),
        (None, "none. at all."), (9, f"x\nOther words. {one.upper()} {two}\ny"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts, got = dict(rows), sorted(tuple(r)[:6] for r in units.repeats(df).collect())
    cut = [(i, texts[i][b:e], f) for i, b, e, _, f, _ in got]
    assert cut == [
        (2, one.upper(), 1), (2, two, 1), (3, one, 1), (7, "Once more.", 6), (8, "Once more.", 6),
        (9, "x", 2), (9, f"Other words. {one.upper()} {two}", 2), (9, "y", 2),
    ]
    left = {r["doc_id"]: r["text"] for r in units.without_repeats(df).collect()}
    assert left[2] == "x\nOther words. \ny" and left[3] == "z" and left[7] == "Down." and left[9] == "" and left[1] == texts[1]


def test_escapes_are_reversible():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[SEP]", "\\", "<", "[", " ", "ok", "<|image:0|>", "/s>", "é"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text
        for role in ("user", "system", "assistant", "tool", "[SEP]", None):
            formatted, begin, end = chat.turn_text(role, chat.escape(text))
            following = chat.turn_text("user", "next")[0]
            assert list(chat.read_turns(formatted + following)) == [(role or "", text, role == "assistant"), ("user", "next", False)]
            assert chat.unescape(formatted[begin:end]) == (text if role == "assistant" else "")


def test_chat_digests(spark):
    prepare(spark)
    rows = [(1, 1, "assistant", "</s>"), (1, 0, "user", None), (2, 0, None, "x\\"), (None, 0, "tool", "t"), (1, 2, "assistant", ""), (1, 1, "assistant", "</s>")]
    df = chat.text_parts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    said = "user\n\nassistant\n</s>\nassistant\n</s>\nassistant\n\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["n_turns"] == 4
    assert got[1]["loss_chars"] == 8 and got[1]["loss_sha256"] == hashlib.sha256(b"</s></s>").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\\\n").hexdigest() and len(got) == 3
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_typed_parts(spark):
    prepare(spark)
    parts = [("text", "see <s>", None, None), ("image", None, "i.png", 600_000), ("audio", None, "a.wav", 3), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    one, two = chat.format_turns(df).orderBy("turn").collect()
    assert one["formatted"] == "[INST] see <\\s><|image:0|><|audio:1|>end [/INST]" and two["formatted"] == "[INST]  [/INST]"
    assert [tuple(a) for a in one["attachments"]] == [(0, "image", "i.png", 768), (1, "audio", "a.wav", 75)]
    assert one["tokens"] > 843 and two["tokens"] == 0
    assert next(chat.read_turns(one["formatted"]))[1] == "see <s>end"


def test_texts_cut_into_parts_read_back(spark):
    """However a text is cut into parts, it reads as the text uncut."""
    prepare(spark)
    rng = random.Random(2)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "<|image:0|>", "\\", "<", "[", " ", "ok", "é"]
    rows, want = [], {}
    for k in range(200):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        parts = [("text", text[a:b], None, None) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        want[k] = text
        if k % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), ("image", None, "i.png", 5))
        rows.append((k, 0, rng.choice(["user", "assistant", "tool"]), parts))
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    for r in chat.format_turns(df).collect():
        assert [t for _, t, _ in chat.read_turns(r["formatted"])] == [want[r["conv_id"]]]


def test_equal_turns_are_ordered_by_text(spark):
    prepare(spark)
    said = ["<s>", "<a", "a", "a\x01", "", "\\", "[INST]", "[Z"]
    rows = [(1, 0, role, t) for t in said for role in ("user", "tool")]
    df = chat.text_parts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = chat.digests(chat.format_turns(df)).collect()
    turns = "".join(f"{role}\n{t}\n" for role in ("tool", "user") for t in sorted(said))
    assert [r["turns_sha256"] for r in got] == [hashlib.sha256(turns.encode()).hexdigest()]


def test_slices_hold_all_rows():
    said = ["a" * n for n in (0, 3, 9, 40, 1, 2, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(said)], names=["text"])
    parts = [p.column("text").to_pylist() for p in sliced(batch, most=10)]
    assert [t for p in parts for t in p] == said and max(sum(len(t or "") for t in p) for p in parts if len(p) > 1) <= 10
    assert list(sliced(batch.slice(0, 0))) == []


def test_language_model_base(odd, odd_texts, none):
    train = odd.where("doc_id > 2 OR doc_id IS NULL")
    got = causal_lm.score(odd, train, common_words=5, steps=30).collect()
    count = Counter()
    for i, t in odd_texts:
        if i is None or i > 2:
            count.update([*map(str, causal_lm.word_list(t or "")), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in odd_texts:
        words = [*SPACES.findall((t or "").translate({c: c + 32 for c in range(65, 91)})), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        want[i, len(words), sum(count[w] > 0 for w in words), n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert causal_lm.score(none, train, steps=5).count() == 0
    assert causal_lm.score(odd, none, steps=5).agg(F.max("train_tokens")).first()[0] == 0


def test_windows_score_each_token_once():
    """Overlapping windows against one token at a time, and probabilities that sum to one."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 200)
    vocab = causal_lm.vocabulary(counts, rng.random(200) < 0.4, groups=8, rows=64)
    assert np.allclose(np.bincount(vocab.group, vocab.share, 8), 1)
    model = causal_lm.Attention(vocab.rows, vocab.groups, width=6)
    model.weights["near"][:] = rng.standard_normal(24)
    ids = [rng.integers(0, 200, n) for n in (1, 5, 16, 17, 90)]
    stride = 16
    want = []
    for one in ids:
        rows, total = np.concatenate([[model.start_row], vocab.row[one]]), 0.0
        for t, target in enumerate(one):
            low = max(0, t // stride * stride - (24 - stride))
            seen = rows[max(low, t - 23) : t + 1][None]
            out, norm, _ = model.forward(seen, np.ones(seen.shape, bool), 1)
            total += out[0, 0, vocab.group[target]] - norm[0, 0] + np.log(vocab.share[target])
        want.append(total / np.log(10))
    assert np.allclose(model.score(ids, vocab), want, rtol=1e-4)


def test_weights_are_fitted_on_all_windows(spark):
    """Every id of every text is predicted in a pass, and sums over tasks equal those in one place."""
    prepare(spark)
    rows = [(k, prose(k, n)) for k, n in enumerate([3, 40, 900, 2500, 0])] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    whole = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    size = max(whole.get_vocab().values()) + 2
    vocab = causal_lm.vocabulary(np.ones(size, np.int64), np.arange(size) % 2 == 0, groups=8, rows=64)
    path = causal_lm.coded(df, packing.TOKENIZER, vocab.end, 2)
    held = spark.read.schema("ids array<int>, slice int").parquet(path)
    assert held.count() == 6
    model = causal_lm.Attention(vocab.rows, vocab.groups, width=4)
    loss, g, n = causal_lm.summed_gradients(held, model, vocab, 33, at_once=16)
    texts = [np.array(r["ids"]) for r in held.collect()]
    assert n == sum(len(t) - 1 for t in texts)
    want_loss, want, m = model.window_gradients(np.concatenate([causal_lm.cut_windows(t, 33) for t in texts]), vocab)
    assert m == n and abs(loss / n - want_loss) < 1e-4
    assert all(np.allclose(g[k] / n, want[k], atol=1e-5) for k in want)
    seen = causal_lm.fit(df, model, vocab, packing.TOKENIZER, 33, slices=2, passes=2, rate=0.05)
    assert sum(k for _, k in seen) == 2 * n and seen[-1][0] < seen[0][0]


def test_gradients():
    rng = np.random.default_rng(1)
    model = causal_lm.Attention(20, 5, width=4, context=6)
    for name in model.weights:
        model.weights[name] = rng.standard_normal(model.weights[name].shape)
    rows, target = rng.integers(0, 21, (3, 8)), rng.integers(0, 5, (3, 8))
    valid, weigh = np.ones((3, 8), bool), (rng.random((3, 8)) < 0.8).astype(float)
    _, slopes = model.gradients(rows, valid, target, weigh)
    for name, value in model.weights.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = model.gradients(rows, valid, target, weigh)[0]
            value[at] = kept - 1e-5
            down = model.gradients(rows, valid, target, weigh)[0]
            value[at] = kept
            assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-3


def test_gradients_of_steep_weights():
    """Beyond the bound under which no maximum is taken off, and over more windows than a block holds."""
    rng = np.random.default_rng(2)
    model = causal_lm.Attention(20, 5, width=4, context=6)
    for name in model.weights:
        model.weights[name] = 8 * rng.standard_normal(model.weights[name].shape)
    many = causal_lm.BLOCK * 2 + 5
    rows, target = rng.integers(0, 21, (many, 8)), rng.integers(0, 5, (many, 8))
    valid, weigh = np.ones((many, 8), bool), (rng.random((many, 8)) < 0.8).astype(float)
    loss, slopes = model.gradients(rows, valid, target, weigh)
    out, norm, _ = model.forward(rows, valid, 8)
    want = -((np.take_along_axis(out, target[:, :, None], 2)[:, :, 0] - norm) * weigh).sum() / weigh.sum()
    assert abs(loss - want) < 1e-6 and all(np.isfinite(g).all() for g in slopes.values())
    parts = [model.gradients(rows[k : k + 9], valid[k : k + 9], target[k : k + 9], weigh[k : k + 9]) for k in range(0, many, 9)]
    share = [weigh[k : k + 9].sum() / weigh.sum() for k in range(0, many, 9)]
    for name in slopes:
        assert np.allclose(sum(p[1][name] * f for p, f in zip(parts, share, strict=True)), slopes[name], atol=1e-6)


def test_texts_get_their_ids_once(spark, odd, monkeypatch):
    """Training rows named by a condition are those of a table, without a second pass over their texts."""
    inside = "doc_id > 2 OR doc_id IS NULL"
    names = ["doc_id", "n_tokens", "n_known", "train_tokens"]

    def rounded(df):
        return Counter((*[r[c] for c in names], round(r["base_score"], 6), round(r["score"], 3)) for r in df.collect())

    want = rounded(causal_lm.score(odd, odd.where(inside), common_words=5, steps=30))
    monkeypatch.delattr(causal_lm, "coded")
    assert rounded(causal_lm.score(odd, F.expr(inside), common_words=5, steps=30)) == want


def test_gradients_are_taken_of_whole_calls(spark):
    """Windows left over by a call wait for the next texts; only the last call of a task is a short one."""
    vocab = causal_lm.vocabulary(np.ones(9, np.int64), np.arange(9) % 2 == 0, groups=4, rows=8)
    rows = [(causal_lm.packed(np.arange(60) % 8, np.array([60]), vocab.end)[0].as_py(),) for _ in range(40)]
    none = np.zeros(2, np.float32)
    short = SimpleNamespace(
        weights={"w": none}, window_gradients=lambda ids, vocab: (float(len(ids) < 16), {"w": none}, len(ids)),
    )
    df = spark.createDataFrame(rows, "ids binary").coalesce(1)
    loss, _, n = causal_lm.summed_gradients(df, short, vocab, 25, at_once=16)
    assert n == 40 * 3 and loss == 40 * 3 % 16


def test_ids_of_a_text_are_one_value(spark, odd):
    """Staged ids are binary, with start and end around them, and those of the words one by one."""
    words = np.array(sorted({causal_lm.word_hash(w) for r in odd.collect() for w in causal_lm.word_list(r["text"] or "")}))[::2]
    named = odd.select("doc_id", "text", F.lit(True).alias("learns"))
    end = 50_257
    held = causal_lm.prepared(named, packing.TOKENIZER, end, words, np.full(len(words), 9))
    assert dict(held.dtypes)["ids"] == "binary"
    encode = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))

    def twin(text):
        said = causal_lm.word_list(text or "")
        ids = [-2, *(k for w in said for k in encode(" " + w)), end]
        rare = Counter(h for h in map(causal_lm.word_hash, [*said, causal_lm.END]) if h not in words)
        known = len(said) + 1 - sum(rare.values())
        return len(said) + 1, known, round(float(known), 6), tuple(sorted(rare.items())), tuple(ids)

    def got(r):
        ids, edges = causal_lm.unpacked(pa.array([r["ids"]], pa.binary()), end)
        assert edges.tolist() == [0, len(ids)]
        return r["n_tokens"], r["known"], round(r["base"], 6), tuple(zip(r["rare"], r["times"], strict=True)), tuple(ids.tolist())

    assert Counter(map(got, held.collect())) == Counter(twin(r["text"]) for r in odd.collect())


def test_packed_ids():
    sizes = np.array([0, 3, 0, 2])
    for end in (9, 253, 254, 70_000):
        column = causal_lm.packed(np.array([0, 1, end - 1, 5, 6], np.uint32), sizes, end)
        for part in (column, column.cast(pa.large_binary())):
            ids, edges = causal_lm.unpacked(part, end)
            assert ids.tolist() == [-2, end, -2, 0, 1, end - 1, end, -2, end, -2, 5, 6, end]
            assert edges.tolist() == [0, 2, 7, 9, 13]
    assert causal_lm.unpacked(pa.array([], pa.binary()), 9)[1].tolist() == [0]


def test_chunks_with_other_white_space():
    """The look at all chunks at once gives the ids of a look at each."""
    encode = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    odd = ["a\u00a0", "\x1cb", "", "c d", "e\nf", *encode.special, "\u3000"]
    for one in odd:
        chunks = ["plain", one, "words."]
        codes, sizes = encode.spaced(chunks)
        want = [encode(" " + c) for c in chunks]
        assert codes.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def brute_align(item, passage):
    table = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            same = alignment.MATCH if item[i - 1] == passage[j - 1] else alignment.MISMATCH
            table[i][j] = max(0, table[i - 1][j - 1] + same, table[i - 1][j] + alignment.GAP, table[i][j - 1] + alignment.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        item = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))])
        passage = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 20))])
        points, begin, end = alignment.align(item, passage)
        assert points == brute_align(item, passage)
        assert points == brute_align(item, passage[begin:end])


def test_leaks(spark, odd, none):
    item, other = prose(50, 30), prose(51, 25)
    words = item.split()
    edited = [*words[:9], "new", *words[10:19], "more", "words", *words[19:]]
    rows = [
        (1, f"{prose(1, 40)} {item.upper()}! {prose(2, 40)}"), (2, f"{prose(3, 10)} {' '.join(edited)}"), (3, prose(4, 200)), (4, None), (5, ""),
        (6, f"{other}\n{item}"), (None, item), (1, f"{prose(1, 40)} {item.upper()}! {prose(2, 40)}"), (7, " ".join(words[:8])),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(0, item), (1, other), (2, None), (3, ""), (None, item), (0, item), (4, "ta mo")], "item_id bigint, text string")
    got = alignment.leaks(df, items).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter([(1, 0), (1, 0), (2, 0), (6, 0), (6, 1), (None, 0)])
    texts = dict(rows[:2])
    assert all(r["score"] == 1 for r in got if r["doc_id"] != 2)
    assert texts[1][slice(*next((r["begin"], r["end"]) for r in got if r["doc_id"] == 1))].lower().rstrip("!") == item
    left = alignment.without_leaks(df, items)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 7] and left.columns == df.columns
    assert alignment.leaks(none, items).count() == 0 and alignment.leaks(df, items.limit(0)).count() == 0
    assert alignment.leaks(odd, items).count() == 0


FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.c_d@e.f x@y z@w.v.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 999.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "+1 (555) 010-2030 ++49 30 1234567. +1-2 +123456789012345678", "é@x.y ünï 😀 a.b@c-d.e-f 10.0.0.1", "%+-@a.b @a.b a@.b", "a@b.c" * 3, "+" * 50 + "1 2 3 4 5 6 7 8 9 0",
]


def test_formats(spark, odd, odd_texts, none):
    rows = [(100 + k, t) for k, t in enumerate(TRICKY)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = identifiers.find(df).collect()
    got = Counter(
        (r["doc_id"], ",".join(f"{k}:{s['begin']}:{s['end']}" for k in identifiers.KINDS for s in r[k])) for r in found
    )
    assert got == Counter((i, brute_spans(t)) for i, t in [*odd_texts, *rows])
    assert identifiers.find(none).count() == 0
    wide = identifiers.without_identifiers(odd.withColumn("email", F.lit(1)).withColumn("found", F.lit("f")))
    masked = {r["doc_id"]: r["text"] for r in wide.collect()}
    assert masked[12] == "mail [REDACTED] now [REDACTED] x [REDACTED] y [REDACTED]" and wide.columns == [*odd.columns, "email", "found"]
    assert masked[4] is None and masked[5] == "" and masked[10] == dict(odd_texts)[10]


def test_patterns_reveal_unseen_identifiers(spark):
    prepare(spark)
    keys = [hashlib.sha1(bytes([k])).hexdigest() for k in range(12)]
    rows = [(k, f'{prose(k, 5)} token = "{key}" end') for k, key in enumerate(keys)]
    rows += [(50, 'some token = "zz-99-not-hex" here'), (51, "version 2.0 of release 3"), (52, "TOKEN = q7-x8"), (53, "release 3 version 2.0")]
    got = {r["doc_id"]: r["found"] for r in identifiers.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    assert all(texts[i][got[i][0]["begin"] : got[i][0]["end"]] == keys[i] for i in range(12))
    assert [s["value"] for s in got[50]] == ["zz-99-not-hex"] and not got[51] and not got[53]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "personal_data", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, left = docs.columns, docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(apply(spark, left, SF_DIR).toPandas(), docs.schema)
        assert left.columns == columns
        if name == "quality_rules":
            judged = queries.op8_quality_rules(spark, SF_DIR).where("kept").select("doc_id")
            assert sorted(left.select("doc_id").collect()) == sorted(judged.collect())
        if name == "near_duplicates":
            kept = left.select("doc_id", "text").collect()
            assert classes([tuple(r) for r in kept]) == {r["doc_id"]: r["doc_id"] for r in kept}
        if name == "personal_data":
            assert not any(brute_spans(r["text"]) for r in left.collect())
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r[0] for r in got.select("doc_id").distinct().collect()) == sorted(r["doc_id"] for r in left.collect())


def test_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    wide = odd.withColumn("found", F.lit(1)).withColumn("n_words", F.lit("w")).withColumn("length", F.lit(2.5))
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, wide, SF_DIR).columns == wide.columns
        apply(spark, wide, SF_DIR).count()
        assert apply(spark, none, SF_DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF_DIR).count() >= wide.count()


def test_whole_queries_on_tables(spark):
    packed = queries.op3_packing(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert packed.where("piece = 0").count() == docs and packed.agg(F.max(F.expr("offset + length"))).first()[0] <= 2048
    marked = {r["doc_id"] for r in queries.op9_benchmark_leaks(spark, SF_DIR).collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    plain = {
        r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
        if any(i in (r["text"] or "") for i in items)
    }
    assert plain <= marked
