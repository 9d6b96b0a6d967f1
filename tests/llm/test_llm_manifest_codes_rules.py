"""Vector codes, the Merkle manifest and the risk-controlled rules against plain versions, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle, quality_rules, vector_codes

LONG = "the quick brown fox \n" * 8000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, tree string, size string, levels string, stratum int"
ODD = [
    (0, None, "en", "a", None), (1, "", "en", None, 0), (2, "   \n\t ", None, "a", 6), (3, LONG, "en", "a", len(LONG)), (4, LONG, "en", "a", len(LONG)), (5, "one\ntwo", "en", "b", 7), (7, "same\n", "en", "c", 5), (7, "same\n", "en", "c", 5),
    (7, "other", "en", "c", 5), (8, "été 日本 🙂\n\n x", "fr", "c", 20), (None, "no id\n", "en", "c", 5), (None, None, None, None, None), (20, "x", "de", "Z", 1), (21, "x", "de", "é", 1), (22, "x", "de", "", 1), *[(100 + i, f"row\n{i}", "en", "hot", 5) for i in range(40)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "t", "s", "l", 2) for r in ODD], SCHEMA).repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows, fanout=3):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def siblings(tree, i):
        for level in tree[:-1]:
            first = i // fanout * fanout
            yield "".join(level[first:i]), "".join(level[i + 1 : first + fanout])
            i //= fanout

    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(by[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            t, h = r["text"], own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                h = leaf(r, t and t.replace("\n", ""))
            for a, b in path:
                h = sha(a + h + b)
            yield r["doc_id"], own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]


def same(got, want):
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_manifest_equals_the_plain_one(spark, small, odd):
    got = merkle.verify(odd).collect()
    assert same(got, plain_manifest([r.asDict() for r in odd.collect()]))
    assert not all(r["verified"] for r in got)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert same(merkle.verify(docs).collect(), plain_manifest([r.asDict() for r in docs.collect()]))


def test_manifest_of_one_row_and_of_none(spark, odd):
    one = odd.filter("doc_id = 5")
    got = merkle.verify(one).collect()
    assert same(got, plain_manifest([r.asDict() for r in one.collect()])) and got[0]["leaf"] == got[0]["root"]
    assert merkle.verify(odd.limit(0)).collect() == []


def test_ranked_counts_through_ranges(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, "hot").when(F.col("id") < 990, F.lit(None)).otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 1000).alias("o"))
    got = merkle.ranked(rows, ["g"], ["o"]).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["g"]].append((r["o"], r["idx"], r["size"]))
    assert len(got) == 1000
    for own in by.values():
        assert [i for _, i, _ in sorted(own)] == list(range(len(own))) and {n for *_, n in own} == {len(own)}


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    if not rows:
        return []
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(c) for c in r[1]]))
    d = max(1, -(-max(len(r[1]) for r in rows) // parts))
    x = [[math.floor(4096 * float(c)) for c in r[1]] + [0] * (d * parts - len(r[1])) for r in rows]
    books = [[v[s * d : s * d + d] for v in x[:entries]] for s in range(parts)]
    far = lambda s, v, c: sum((a - b) ** 2 for a, b in zip(v[s * d : s * d + d], c, strict=True))
    near = lambda s, v: min(range(len(books[s])), key=lambda e: (far(s, v, books[s][e]), e))
    for _ in range(rounds):
        for s in range(parts):
            own = collections.defaultdict(list)
            for v in x:
                own[near(s, v)].append(v[s * d : s * d + d])
            books[s] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if own[e] else books[s][e] for e in range(len(books[s]))]
    codes = [[near(s, v) for s in range(parts)] for v in x]
    errors = [sum(far(s, v, books[s][e]) for s, e in enumerate(c)) for v, c in zip(x, codes, strict=True)]
    total = collections.Counter()
    for r, e in zip(rows, errors, strict=True):
        total[r[2]] += e
    name = sha(",".join(str(c) for b in books for e in b for c in e))
    return [(r[0], "".join(f"{e:02x}" for e in c), e_, total[r[2]], name) for r, c, e_ in zip(rows, codes, errors, strict=True)]


EMBEDDED = "vec_id long, embedding array<float>, label int, error string, code int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "e", 1) for r in rows], EMBEDDED).repartition(3)


def exact(rows):
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]


def test_codes_equal_plain_lloyd(spark, monkeypatch):
    rng = np.random.default_rng(3)
    many = [(int(i), rng.normal(size=16).round(1).tolist(), int(i % 3) if i % 7 else None) for i in rng.permutation(300)]  # coarse, so that distances tie
    monkeypatch.setattr(vector_codes, "BLOCK", 64)  # several blocks a task
    assert same(vector_codes.codes_and_errors(vectors(spark, many)).collect(), plain_codes(exact(many)))


def test_codes_on_odd_vectors(spark):
    odd = [(3, [1.0] * 9, 1), (3, [1.0] * 9, 1), (3, [0.5] * 9, 1), (None, [2.0, -1.0], None), (1, None, 1), (2, [1.0, None], 1), (4, [float("nan")], 1), (5, [float("inf")], 1), (6, [], 2), (7, [-0.0001] * 9, None), *[(i, [1.0] * 9, 9) for i in range(10, 40)]]
    assert same(vector_codes.codes_and_errors(vectors(spark, odd)).collect(), plain_codes(exact(odd)))
    few = odd[:1]
    assert same(vector_codes.codes_and_errors(vectors(spark, few)).collect(), plain_codes(exact(few)))
    assert vector_codes.codes_and_errors(vectors(spark, odd[4:8])).collect() == []
    assert vector_codes.codes_and_errors(vectors(spark, odd).limit(0)).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.codes_and_errors(vectors(spark, [(1, [1e30] * 8, 1)]))


def test_heaps_pop_less_than_everything():
    rng = np.random.default_rng(0)
    v = np.floor(4096 * (rng.normal(size=(4000, 16)) + 3 * rng.integers(0, 8, size=(4000, 1)))).astype(np.int32)
    block, books = vector_codes.Block(v, (8, 4)), vector_codes.Books(v[:4].astype(np.int64).reshape(4, 8, 2).transpose(1, 0, 2), np.zeros((8, 4)), 1e-3)
    total, popped = 0, []
    own = vector_codes.Block.popped
    for _ in range(8):
        seen = 0

        def counting(self, s, b):
            nonlocal seen
            out = own(self, s, b)
            seen += len(out[0])
            return out

        block.popped = counting.__get__(block)
        total = total + block.advance(books)
        popped.append(seen)
        n = np.maximum(total[:, :, -1:], 1)
        books = books.moved(np.where(total[:, :, -1:] > 0, total[:, :, :-1] // n, books.entries))
    assert popped[0] == 8 * 4000 and popped[-1] < popped[0] / 4


BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(t):
    t = t or ""
    w = BLANKS.findall(t)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if BLANKS.search(x)]
    letters = [c for c in t if c.isalpha()]
    marks = sum(c not in " \t\n\x0b\x0c\r" and not c.isalnum() for c in t)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(lines), len(letters), sum(c.isupper() for c in letters), marks


@pytest.mark.parametrize("text", [None, "", " \n\t ", "a b c a b c", "a a a a", "a\x0bb\x1cc d e f", "x\nx\n \nx \nx", "É#é ß*1 ٣ \U0001f642|", "one two three", LONG])
def test_measures(text):
    assert quality_rules.measure(text) == plain_measures(text)


def plain_judge(rows, labels, share):
    """The whole query over lists: every candidate's costs by counting documents again."""
    least = {}
    for d, q in labels:
        if q in (0, 1):
            least[d] = min(q, least.get(d, 1))
    names = dict(zip(quality_rules.COUNTS, range(9), strict=True))
    docs = []
    for r in rows:
        m = plain_measures(r["text"])
        levels = [math.ceil(64 * math.sqrt(min(1.0, m[names[a]] * f / max(1, m[names[b]])))) for a, b, f in quality_rules.RULES.values()]
        docs.append((r["doc_id"], r["lang"], m, levels, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    known = [(d[1], d[3], least[d[0]], share[d[0]] < 2 / 3) for d in docs if not d[4] and d[0] in least]
    strata, cuts = {k[0] for k in known}, {}
    fitted = {s for s in strata if any(k[0] == s and not k[3] for k in known)}
    for s in fitted:
        fit, held = [k for k in known if k[0] == s and not k[3]], [k for k in known if k[0] == s and k[3]]
        lost = lambda rows, q, r, c: sum(k[1][r] > c for k in rows if k[2] == q) / max(1, sum(k[2] == q for k in rows))
        steps = []
        for r in range(len(quality_rules.RULES)):
            for c in range(63, -1, -1):
                bad, good = lost(fit, 0, r, c), lost(fit, 1, r, c)
                if bad > lost(fit, 0, r, c + 1) and bad > good:
                    low = min(x for x in range(65) if lost(fit, 1, r, x) == good)
                    steps.append((good, -bad, r, c - (c - low) // 3))
        path, best, chosen = sorted(steps), 0, 0
        gone = lambda rows, q, n: sum(k[2] == q and any(k[1][r] > c for *_, r, c in path[:n]) for k in rows)
        n_good = sum(k[2] == 1 for k in held)
        for n in range(1, len(path) + 1):
            x = gone(held, 1, n)
            p = sum(math.comb(n_good, i) * quality_rules.RISK**i * (1 - quality_rules.RISK) ** (n_good - i) for i in range(x + 1))
            if not n_good or p > quality_rules.DELTA / len(fitted):
                break
            if gone(fit, 0, n) > best:
                best, chosen = gone(fit, 0, n), n
        cuts[s] = [min([c for *_, q, c in path[:chosen] if q == r], default=64) for r in range(len(quality_rules.RULES))]
    return [(d, *m[:5], base, not base and not any(x > c for x, c in zip(levels, cuts.get(s, [64] * 6), strict=True))) for d, s, m, levels, base in docs]


def texts(n):
    rng = np.random.default_rng(1)
    for i in range(n):
        words = [f"{'Word' if k % 9 == 0 else 'word'}{rng.integers(0, 500)}" for k in range(60 + i % 40)]
        bad = i % 5 == 0
        mark = ["***", "!!", "|"][i % 3] if bad else ""
        yield i, " ".join(w.upper() + mark if bad and i % 2 else w + mark for w in words) + ("\nend\nend" if i % 7 == 0 else ""), ["en", "de", None][i % 3 if i < 900 else 0], int(not bad)


def test_rules_equal_the_plain_procedure(spark):
    rows = [*texts(1500)]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s, _ in rows] + [(None, "no id", "en", 1), (9000, None, "en", 1), (9001, LONG, "xx", 1), (0, rows[0][1], "en", 1)], "doc_id long, text string, lang string, levels int").repartition(3)
    labels = [(i, q) for i, _, _, q in rows] + [(3, 0), (4, None), (5, 7), (None, 1), (9002, 1)]
    got = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    share = {r[0]: r[1] for r in spark.range(9010).select("id", quality_rules.unit_hash(F.col("id").cast("string"), "holdout")).collect()}
    assert same(got, plain_judge([r.asDict() for r in docs.collect()], labels, share))
    by = {r["doc_id"]: r for r in got}
    assert not any(by[i]["kept"] for i, _, s, q in rows if q == 0 and s == "en") and all(by[i]["kept"] for i, *_, q in rows if q == 1)


def test_rules_without_labels_or_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judge(odd, labels).collect()
    assert len(got) == len(ODD) and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.judge(odd.limit(0), labels).collect() == []


def test_binomial_tail():
    assert math.isclose(quality_rules.at_most(0, 100, 0.04), 0.96**100, rel_tol=1e-9) and math.isclose(quality_rules.at_most(10, 10, 0.3), 1.0)
    assert math.isclose(quality_rules.at_most(3, 10, 0.3), sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(4)), rel_tol=1e-9)
    assert quality_rules.safe_steps([0, 0, 50, 0], 300, 0.05) == 2 and quality_rules.safe_steps([0], 20, 0.05) == 0 and quality_rules.safe_steps([0], 0, 0.05) == 0
