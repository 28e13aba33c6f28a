"""SimHash, phrases and filter audit against brute force, with odd rows."""

import os
import random
import re
import subprocess
import sys
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import audit, phrases, queries, simhash
from packetloom.llm.common import prepare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def prose(seed, n, vocabulary=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(["Ta", "mo", "ri", "ke"]) + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    base = prose(1, 200)
    return [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base.replace(" ", "\n", 5), None, "a"), (4, None, None, None),
        (5, "", "en", ""), (6, " \t\n", "en", "b"), (7, "one two", "de", "b"), (7, "one two", "de", "b"),
        (8, "one two", "de", "c"), (None, base, "en", "a"), (None, None, None, "a"), (9, prose(9, 30_000), "en", "b"),
        (9, prose(2, 50), "en", "b"), (10, "x" * 30_000, "fr", "c"), (11, "!?.,;:\x0b\x0c " * 50, "fr", "c"),
        (12, "naïve café ÀÉ € \x1c \x00 end " * 30, "fr", "c"), (13, "AB# " * 60, "en", "a"),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    prepare(spark)
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in odd_rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_print(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    size = min(n, len(words))
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_classes(prints, radius=4):
    """Smallest id reachable for rows of (id, fingerprint)."""
    values = sorted({f for _, f in prints})
    label = {f: f for f in values}
    todo = set(values)
    while todo:
        queue = [todo.pop()]
        root = queue[0]
        while queue:
            f = queue.pop()
            label[f] = root
            near = [g for g in todo if (f ^ g).bit_count() <= radius]
            todo -= set(near)
            queue += near
    least = {}
    for i, f in prints:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return [least.get(label[f]) if i is not None else None for i, f in prints]


def test_fingerprints_of_odd_rows(odd, odd_rows, none):
    rows = simhash.near_copies(odd.withColumn("fp", F.lit(1)).withColumn("node", F.lit("x"))).collect()
    prints = [(i, brute_print(t)) for i, t, *_ in odd_rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_classes(prints), strict=True)), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want
    assert simhash.near_copies(none).collect() == []


def test_spark_hashes_alike(spark):
    got = spark.sql("SELECT xxhash64('ta1 mo2 ri3 ké4') AS h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest("ta1 mo2 ri3 ké4".encode(), 42)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    sizes, values = rng.integers(2, 200, 25), []
    for n in sizes:
        v = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, n)]
        for k in range(n):
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                v[k] ^= np.uint64(1) << np.uint64(b)
        values.append(v)
    got = [p for i, j in simhash.near_pairs(np.concatenate(values), sizes, radius) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want, first = set(), 0
    for v in values:
        i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= radius, 1))
        want |= set(zip((first + i).tolist(), (first + j).tolist(), strict=True))
        first += len(v)
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n", [2, 64, 65])
def test_one_small_region_alone(n):
    """A task may get a single region of at most one word of 64 values."""
    values = np.arange(n, dtype=np.uint64)
    got = {p for i, j in simhash.near_pairs(values, np.array([n]), 2) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if (i ^ j).bit_count() <= 2}


def test_full_buckets_lose_no_pair(spark):
    """One tight cluster far beyond the tile: cut by further bits and compared in tiles."""
    rng = random.Random(4)
    base, values = rng.getrandbits(63), set()
    while len(values) < 400:
        f = base
        for _ in range(rng.randrange(9)):
            f ^= 1 << rng.randrange(63)
        values.add(f)
    values = sorted(values)
    prints = spark.createDataFrame([(f,) for f in values], "fp bigint")
    groups = simhash.buckets(prints, 4, tile=10, tiles=3).cache()
    assert groups.select("level").distinct().count() > 2
    assert groups.groupBy("level", "path", "key", "part").count().agg(F.max("count")).first()[0] <= 60
    got = {frozenset((r.a, r.b)) for r in simhash.links(groups, 4).collect()}
    label = {f: f for f in values}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for pair in got:
        a, b = pair
        label[max(root(a), root(b))] = min(root(a), root(b))
    mine = [root(f) for f in values]
    want = brute_classes([(f, f) for f in values])
    assert mine == want


def brute_phrases(rows, least=10, cover=50, top=2000):
    found = {}
    for lang, text in rows:
        counts = found.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                counts.update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, f in found.items():
        n, kept = sum(c for p, c in f.items() if len(p) == 1), []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and p in (q[:2], q[1:]) for q, b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("bucket_words", [300, phrases.BUCKET_WORDS])
def test_phrases_by_brute_force(spark, odd, odd_rows, none, bucket_words, monkeypatch):
    got = phrases.collocations(odd.withColumn("n", F.lit(1)).withColumn("phrase", F.lit("")), 3, 50, 40, bucket_words)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases([(r[2], r[1]) for r in odd_rows], 3, 50, 40)
    assert phrases.collocations(none).collect() == []


def test_long_text_is_cut_where_words_end(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 16)
    text = "Ab cd, ef  gh\tij. kl\n\nmn op qr st uv wx yz abcdefghijklmnopqrstuvwxyz 12"
    numbers = phrases.Numbers()
    got = [numbers.words()[k].decode() if k >= 0 else None for k in phrases.numbered(text, numbers)]
    want = [w for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()) for w in [*re.findall(r"[^\x20\x09]+", piece), None]]
    assert got == want


def test_partitions_are_counts():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 6, 900), rng.integers(-1, 5, 900), rng.integers(-1, 5, 900)]
    keys[2][keys[1] < 0] = -1
    sizes = rng.integers(1, 4, 900)
    for least in (1, 10):
        got = {}
        for depth, member, n in phrases.equal_partitions(keys, sizes, [least] * 3):
            got |= {tuple(int(k[m]) for k in keys[: depth + 1]): int(c) for m, c in zip(member, n, strict=True)}
        want = Counter()
        for row, c in zip(zip(*keys, strict=True), sizes, strict=True):
            for m in (1, 2, 3):
                if row[m - 1] >= 0 and all(x >= 0 for x in row[:m]):
                    want[tuple(map(int, row[:m]))] += int(c)
        assert got == {p: c for p, c in want.items() if c >= least}


def test_wide_combination_equals_packed():
    rng = np.random.default_rng(1)
    one, two, three = rng.integers(0, 9, 500), rng.integers(0, 9, 500), rng.integers(-1, 9, 500)
    small, large = phrases._combined(one, two, three, 9), phrases._combined(one, two, three, 1 << 22)
    assert (small[0] == large[0]).all() and (small[1] == large[1]).all()


def brute_audit(rows, labels):
    """Rows of (part, id, text): equal part and id are one document."""
    first, docs = {}, {}
    for _, i, text in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for part, i, text in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        docs.setdefault((part or "", i), set()).update(x for x in fails if fails[x])
    out = []
    for part in {p for p, _ in docs}:
        mine = {i: f for (p, i), f in docs.items() if p == part}
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = dict(mine)
            for k, x in enumerate(order):
                gone = [i for i, f in left.items() if x in f]
                left = {i: f for i, f in left.items() if x not in f}
                shapley[x] += len(gone)
                failing = sum(x in f for f in mine.values())
                steps.append((
                    part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(f == {x} for f in mine.values()),
                    sum(labels.get(i, (0, 0))[0] == 1 for i in gone), sum(labels.get(i, (0, 0))[1] == 1 for i in gone), x,
                ))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_by_brute_force(spark, odd, odd_rows, none):
    told = {1: (1, 0), 2: (0, 1), 7: (1, 1), 8: (None, 1), 13: (1, None)}
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in told.items()] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    clashing = odd.withColumn("part", F.lit("x")).withColumn("A", F.lit(1)).withColumn("good", F.lit(1))
    got = audit.interactions(audit.failures(clashing, labels), "ABCDE").collect()
    assert sorted(tuple(r) for r in got) == brute_audit([(r[3], r[0], r[1]) for r in odd_rows], told)
    assert audit.interactions(audit.failures(none, labels), "ABCDE").collect() == []


def test_audit_over_many_ranges(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice("xyy"), rng.randrange(900), *[rng.random() < p for p in (0.1, 0.5, 0.9)], rng.random() < 0.5, False) for _ in range(1500)]
    flags = spark.createDataFrame(rows, "part string, doc_id bigint, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    whole = sorted(audit.interactions(flags, "ABC").collect())
    monkeypatch.setattr(audit, "RANGE", 7)
    assert sorted(audit.interactions(flags, "ABC").collect()) == whole
    total = len({(p, i) for p, i, *_ in rows if p == "y"})
    last = [r for r in whole if r.part == "y" and r.step == 3]
    failing = {i for p, i, a, b, c, *_ in rows if p == "y" and (a or b or c)}
    assert {r.kept for r in last} == {total - len(failing)}


def test_galloping_merges():
    rng = np.random.default_rng(5)
    for n, m in ((0, 5), (5, 0), (1, 1000), (1000, 1), (700, 900), (3000, 40)):
        a, b = (np.unique(rng.integers(0, 4000, k)) for k in (n, m))
        assert (audit.gallop(a, b) == np.searchsorted(a, b)).all()
        assert (audit.union(a, b) == np.union1d(a, b)).all()
        assert (audit.within(b, a) == np.isin(b, a)).all()


@pytest.mark.parametrize("name", ["op11_simhash", "op12_collocations", "op13_filter_audit"])
def test_queries_return_the_contract(spark, name):
    columns = {
        "op11_simhash": "doc_id,fingerprint,component_id", "op12_collocations": "lang,rank,phrase,a,l,r,n,score",
        "op13_filter_audit": "part,filter_order,step,kept,removed,redundant,unique_fails,good_lost,toxic_lost,shapley",
    }[name].split(",")
    found = queries.QUERIES[name](spark, SF_DIR)
    assert found.columns == columns and found.count() > 0


@pytest.mark.parametrize("name", ["op7_causal_lm", "op9_benchmark_leaks", "op12_collocations"])
def test_executors_need_no_installation(name, tmp_path):
    """Workers start in another folder, so that they find the package nowhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
import __spark_entry__ as entry
print("rows", entry.queries()[{name!r}](spark, {SF_DIR!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]
