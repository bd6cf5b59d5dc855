"""Filter audit, personal data and whitening against brute force."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketscope.llm import audit, pii, queries, whitening

# Filter audit


def plain_audit(docs, labels):
    """The contract, document by document and order by order."""
    good = {i for i, quality, _ in labels if quality == 1}
    bad = {i for i, _, toxic in labels if toxic == 1}
    rows = {}
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(
                i is not None and i < doc_id and (t or "") == text for i, t, _ in docs),
        }
        for order in map("".join, itertools.permutations("ABCDE")):
            there = True
            for step, name in enumerate(order, 1):
                row = rows.setdefault((lang or "", order, step), dict.fromkeys(audit.OUTCOMES, 0))
                removed = there and fails[name]
                row["redundant"] += fails[name] and not there
                there = there and not fails[name]
                row["kept"] += there
                row["removed"] += removed
                row["unique_fails"] += fails[name] and sum(fails.values()) == 1
                row["good_lost"] += removed and doc_id is not None and doc_id in good
                row["toxic_lost"] += removed and doc_id is not None and doc_id in bad
    for (part, order, step), row in rows.items():
        row["shapley"] = sum(
            other["removed"] for (p, o, s), other in rows.items() if p == part and o[s - 1] == order[step - 1])
    return rows


def audit_documents():
    r = random.Random(3)
    long = " ".join(f"w{i}" for i in range(150))
    texts = [None, "", "", long, long, long.upper(), long + " $", "a " * 200, "a " * 200, "A B C", "x" * 9 + "É", long,
             " \t\n\x0b\x0c\r ", "one\x1ctwo\x85three four", "word " * 120 + "& ABC"]
    docs = [(i, t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += [(3, long, "fr"), (3, long, "en"), (None, long, "en"), (None, long, "en"), (None, None, None), (20, long, "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(20)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = audit_documents()
    frame = spark.createDataFrame([(*d, "m", 1, True) for d in docs],
                                  "doc_id long, text string, lang string, mask string, n int, good boolean")
    named = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    expected = plain_audit(docs, labels)
    found = audit.audit(frame, named).collect()
    assert len(found) == len(expected) == 600 * len({lang or "" for _, _, lang in docs})
    for row in found:
        got = {name: row[name] for name in (*audit.OUTCOMES, "shapley")}
        assert got == expected[row.part, row.filter_order, row.step], (row.part, row.filter_order, row.step)
    assert audit.audit(frame.limit(0), named).count() == 0
    unlabelled = audit.audit(frame, named.limit(0)).agg(F.sum("good_lost"), F.sum("kept")).first()
    assert unlabelled[0] == 0 and unlabelled[1] == sum(x["kept"] for x in expected.values())


def test_packed_counters_do_not_overflow():
    total, expected = 0, 0
    for mask, good, toxic, n in ((31, True, True, 2**40 + 3), (0, False, False, 2**62), (5, True, False, 2**61 - 1)):
        total += n * audit.wide_counter(mask, good, toxic)
        expected = expected + n * audit.outcomes(mask, good, toxic).astype(object)
    assert (audit.unpacked(total).astype(object) == expected).all()
    assert audit.unpacked(0).sum() == 0


def test_many_parts_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD_PARTS", 2)
    rows = [(f"p{i % 7}", i % 32, False, False, 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long")
    sums = {r.part: audit.unpacked(int.from_bytes(r.total, "little")) for r in audit.summed_counters(frame).collect()}
    for part in {p for p, *_ in rows}:
        assert (sums[part] == sum(audit.outcomes(m, False, False) for p, m, *_ in rows if p == part)).all()


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            sound = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if sound:
                found.append((m.start(), rank, m.end(), kind))
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


@pytest.fixture(scope="module")
def judge(spark):
    return pii.train(spark, 6_000)


def pii_texts():
    r = random.Random(12)
    pieces = ["a@b.c", "+d@e.f", "_x@y-z.org", "@", ".", "1.2.3.4", ".255.0.1", "300.1.1.1", "001.2.3.0004", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "378282246310005", " ", "-", "+1 (743) 555-3824", "+49", "(0", "0)", "é𝔸", "\n", "at", "dot", "x",
              "5555555555554444", "+", "%", "9", "12", "a.b_c%d"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(600)]
    return texts + [None, "", "no data here", "a@b.c_d@e.f", "mail x.y+z@mail5.example.com, +1 (523) 555-1055.",
                    "1.2.3.4.5.6.7.8", "1.2.3.256.4.5.6", "4111 1111 1111 1111 4111 1111 1111 1111"]


def test_base_spans_equal_the_patterns(spark, judge):
    texts = pii_texts()
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, base int")
    rows = {r.doc_id: r for r in pii.digests(frame, judge).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = plain_base(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        counts = {kind: sum(b.startswith(kind) for b in base) for kind in BASE}
        assert {kind: rows[i][f"n_{kind}"] for kind in BASE} == counts
        spans = rows[i].spans.split(",") if rows[i].spans else []
        assert set(base) <= set(spans) and len(spans) == len(base) + rows[i].n_added
        starts = [(int(s.split(":")[1]), list(BASE).index(s.split(":")[0])) for s in spans]
        assert starts == sorted(starts)


def test_candidates_find_what_the_base_misses(spark, judge):
    found_in = {
        "Please call (0171) 555298 today": "(0171) 555298", "telefon 030 12 34 56 78, danke": "030 12 34 56 78",
        "write to jane.roe [at] example [dot] org soon": "jane.roe [at] example [dot] org",
        "server 10[.]20[.]30[.]40 is down": "10[.]20[.]30[.]40", "host 2001:db8:85a3:8d3:1319:8a2e:370:7348 answers": "2001:db8:85a3:8d3:1319:8a2e:370:7348",
        "cards 4111111111111111 5555555555554444 both": "4111111111111111", "my visa 4111.1111.1111.1111 ok": "4111.1111.1111.1111",
    }
    clean = ["meet at noon. Then we go", "the meeting at 12:30:45 was long", "order 12345678 of 2024-05-17", "pages 1990-1995",
             "look at the dot matrix", "ISBN 978-3-16-148410-0", "population 1 250 000 people", "pi is 3.14159265 or so",
             "tracking 4111111111111112 sent", "std::vector and a::b", None, ""]
    texts = [*found_in, *clean]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.digests(frame, judge).collect()}
    for i, text in enumerate(texts):
        spans = [s.split(":") for s in rows[i].spans.split(",") if s]
        values = [text[int(a):int(b)] for _, a, b in spans]
        assert found_in[text] in values if text in found_in else not values, (text, values)
    masked = {r.doc_id: r.text for r in pii.redact(frame, judge).collect()}
    assert masked[2] == "write to [EMAIL] soon" and masked[5] == "cards [CARD] [CARD] both"
    assert [masked[i] for i in range(len(found_in), len(texts))] == clean


def test_repeated_rows_rows_without_id_and_no_rows(spark, judge):
    frame = spark.createDataFrame(
        [(1, "a@b.c", "x"), (1, "a@b.c", "y"), (1, "1.2.3.4", "z"), (None, "a@b.c", "n"), (None, None, "m")],
        "doc_id long, text string, kind string")
    rows = pii.digests(frame, judge).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in rows) == [
        (0, ""), (0, "email:0:5"), (1, "email:0:5"), (1, "email:0:5"), (1, "ip:0:7")]
    assert sorted((r.text or "", r.kind) for r in pii.redact(frame, judge).collect()) == [
        ("", "m"), ("[EMAIL]", "n"), ("[EMAIL]", "x"), ("[EMAIL]", "y"), ("[IP]", "z")]
    assert pii.digests(frame.limit(0), judge).count() == 0


def test_long_texts_take_linear_time(spark, judge):
    n = 300_000
    texts = ["a" * n, "a." * n, "1" * n, "1." * n, "1 " * n, "+1" * n, "a@" * n, "a@b" + ".c" * n, "0" * n + "1.1.2.3", ":a" * n,
             "(" * n, "x at " * n, "+1" + " " * n]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    rows = {r.doc_id: r for r in pii.digests(frame, judge).collect()}
    assert time.time() - start < 120
    assert rows[7].n_email == 1 and rows[8].n_ip == 1 and rows[0].spans == "" and rows[3].n_ip == n // 4


def test_proposals_that_overlap_become_one_redaction(spark, judge):
    found = spark.createDataFrame(
        [(1, 5, "phone", False, "c", s, e, "", "") for s, e in ((10, 30), (0, 12), (40, 50))]
        + [(1, 5, "email", True, "c", 45, 60, "", ""), (2, 5, "card", False, "c", 0, 20, "", "")],
        "id long, text_hash long, kind string, base boolean, c string, start long, end long, before string, after string")
    kept = {(r.id, r.start, r.end, r.base) for r in pii.proposals(found).collect()}
    assert kept == {(1, 10, 30, False), (1, 0, 12, False), (1, 45, 60, True), (2, 0, 20, False)}


def test_thresholds_and_luhn(spark):
    assert pii.least_score([(0.9, 1.0), (0.8, 1.0), (0.7, 0.0), (0.6, 1.0)], 0.99) == 0.8
    assert pii.least_score([(0.9, 0.0), (0.9, 1.0)], 0.99) > 1 and pii.least_score([], 0.99) > 1
    digits = ["", "0", "18", "79927398713", "79927398710", "4111111111111111"]
    frame = spark.createDataFrame([(d,) for d in digits], "d string")
    assert [r[0] for r in frame.select(pii.luhn(F.col("d"))).collect()] == [bool(d) and plain_luhn(d) for d in digits]


def test_held_out_findings_of_all_kinds(spark, judge):
    made = pii.labelled_findings(spark, 9_000).withColumn("id", F.lit(1)).filter("fold < 300")
    right = pii.scored(made, judge.trees).groupBy("kind").agg(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")))
    assert all(share > 0.95 for _, share in right.collect())


def test_pii_runs_no_python(spark, judge):
    plan = pii.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"), judge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


# Whitening


def plain_whitening(vectors, k=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    xc = x - np.array([s / n for s in sums])
    values, turn = np.linalg.eigh(xc.T @ xc / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    apart = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return xc @ turn / np.sqrt(values), values, apart, float((xc * xc).sum() / n)


def compared(rows, ids, vectors):
    expected, values, apart, trace = plain_whitening(vectors)
    found = {(r.vec_id, r.component): r for r in rows}
    k = expected.shape[1]
    got = np.array([[found[i, c + 1].whitened for c in range(k)] for i in ids])
    signs = np.sign((got * expected).sum(axis=0))
    assert np.abs(got * signs - expected).max() < 1e-8
    for c in range(k):
        assert found[ids[0], c + 1].explained == pytest.approx(values[c] / trace, rel=1e-10)
    assert [found[i, 1].deviation for i in ids] == apart
    assert all(r.identity_error < 1e-9 for r in rows) and {r.n for r in rows} == {len(vectors)}
    assert len(rows) == k * len(ids)


def test_whitening_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 20_000)
    r = np.random.default_rng(5)
    vectors = (r.normal(size=(400, 48)) * np.linspace(1, 2, 48)).astype(np.float32)
    vectors[200:210] = vectors[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    odd = [(9000, None, "x"), (9001, [1.0, None] * 24, "x"), (9002, [float("nan")] * 48, "x"), (9003, [float("inf")] * 48, "x"),
           (9004, [], "x")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n string")
    compared(whitening.whiten(frame).collect(), list(range(400)), vectors)


def test_whitening_of_small_and_flat_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    # Two vectors have one direction, which both lengths have apart.
    mixed = [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 7.0]), (None, [2.0, 0.0, 7.0])]
    rows = whitening.whiten(spark.createDataFrame(mixed, kind)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in rows) == [(0, 1, 3), (1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3)]
    assert all(abs(r.explained - 1) < 1e-9 for r in rows)


def test_huge_components(spark):
    rows = [(1, [1e30, 0.5]), (2, [-1e30, 0.25]), (3, [2.0, 0.125])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and all(r.deviation is None for r in found if r.vec_id == 1)
    x = [[2**63 - 1, 100_512], [-(2**63), 100_256], [102_048, 100_128]]
    sums = [sum(c) for c in zip(*x)]
    for r in found:
        assert int(r.deviation_digits) == sum((3 * a - s) ** 2 for a, s in zip(x[r.vec_id - 1], sums))


def test_deviations_are_exact():
    r = np.random.default_rng(2)
    for scale, n in ((50, 7), (10**6, 10**9), (10**9, 10**9), (2**40, 10**7), (2**62, 5)):
        x = r.integers(-scale, scale, size=(6, 5))
        sums = tuple(int(s) for s in r.integers(-scale, scale, size=5) * np.array(n // 2 + 1, dtype=object))
        expected = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert whitening.deviations(x, n, sums) == expected


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 1.1, 90), 0.5 ** np.arange(90.0), np.r_[np.ones(40), 1e-9 * np.ones(50)], np.r_[np.full(9, 3.0), np.ones(81)],
])
def test_filtered_subspaces_converge(spectrum):
    r = np.random.default_rng(1)
    turn = np.linalg.qr(r.normal(size=(90, 90)))[0]
    matrix = turn * spectrum @ turn.T
    passes = []
    values, vectors = whitening.leading(lambda q: (passes.append(1), matrix @ q)[1], 90, float(spectrum.sum()))
    top = np.sort(spectrum)[::-1][:8]
    assert np.allclose(values, top, rtol=1e-11) and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-10 * top[0] and len(passes) < 400


def test_a_block_that_does_not_converge_raises(monkeypatch):
    monkeypatch.setattr(whitening, "CYCLES", 1)
    with pytest.raises(RuntimeError):
        whitening.leading(lambda q: np.arange(1, 91)[:, None] * q, 90, 4095.0)


def test_new_queries_are_registered():
    assert {"op11_filter_audit", "op12_pii", "op13_whitening"} <= set(queries.queries())
