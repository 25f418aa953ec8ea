import numpy as np

from oracle import compare, connect
from tagloom.llm.line_templates import ORACLE, drop_lines, line_report, repeated_lines

SF = "/root/testdata/sf0.01"


def by_hand(rows):
    """Lines (doc, number) with a template of an earlier document."""
    lines = []
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            t = [("<*>" if any(c in "0123456789" for c in x) else x) for x in line.split()]
            if len(t) >= 4:
                lines.append((doc, k, t))

    def match(a, b):
        if len(a) != len(b) or a[:3] != b[:3]:
            return False
        w = len(a) // 5
        off = [i for i in range(len(a)) if a[i] != b[i]]
        return not off or (w > 0 and len({(i - 3) // w for i in off}) == 1)

    return {(d, k) for d, k, t in lines if any(e < d and match(t, u) for e, _, u in lines)}


def test_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    report = line_report(docs, repeated_lines(docs))
    assert compare("op1", report, connect(SF), ORACLE) is None
    assert sum(r.n_dropped for r in report.collect()) > 100


def test_templates(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(150):
        words = ["the", "log", "line", *rng.choice(["x", "y"], 2), "tail", "of", "it", str(rng.integers(9)), "end"]
        rows.append((k, "\n".join([" ".join(words), f"user {k} logged in from 10.0.0.{k}", f"alone{chr(97 + k % 26)} w{'x' * k} b c"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, k) for r in repeated_lines(df).collect() for k in r.dropped}
    assert got == by_hand(rows) and (5, 1) in got and (0, 1) not in got


def test_edges(spark):
    line = "one two three four five"
    rows = [(1, None), (2, ""), (3, f"{line}\n\nx"), (4, f"{line}\n{line}"), (4, f"{line}\n{line}"), (None, f"{line}\nstay here"), (5, "a b c"), (6, "a b c"), (7, (line + " ") * 20_000), (8, (line + " ") * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, dropped int")
    repeats = repeated_lines(df)
    out = sorted(((r.doc_id, r.text) for r in drop_lines(df, repeats).collect()), key=str)
    assert drop_lines(df, repeats).columns == df.columns
    want = [(1, None), (2, ""), (3, f"{line}\n\nx"), (4, ""), (4, ""), (None, "stay here"), (5, "a b c"), (6, "a b c"), (7, rows[8][1]), (8, "")]
    assert out == sorted(want, key=str)
    assert repeated_lines(df.limit(0)).collect() == [] and drop_lines(df.limit(0), repeats).collect() == []
    assert line_report(df, repeats).count() == 10


def test_numeric_tables_are_no_templates(spark):
    row = lambda k, n: " ".join(str(k * 31 + i * 7) for i in range(n))
    table = lambda k: "\n".join(row(k * 10 + i, n) for i, n in enumerate((4, 5, 6, 12)))
    log = "the door of room {} was opened by guest {} at night"
    rows = [
        (1, table(1)), (2, table(2)), (3, f"own words\n{table(3)}\n{table(1)}"), (4, table(1)),
        (5, f"Paris {row(5, 4)}"), (6, f"Paris {row(6, 4)}"),  # one constant token of five
        (7, log.format(1, 2) + "\nmore here"), (8, log.format(3, 4) + "\nother things"),  # a log line with other numbers goes
        (9, log.format(5, 6)), (10, f"{log.format(7, 8)}\n{log.format(1, 2)}"), (11, log.format(1, 2)),  # but not as all of a document
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = drop_lines(df, repeated_lines(df, careful=True), drop_emptied=True)
    want = dict(rows) | {3: f"own words\n{table(3)}", 8: "other things", 10: log.format(7, 8)}
    assert {r.doc_id: r.text for r in out.collect()} == {k: v for k, v in want.items() if k not in (4, 11)}


def test_careful_lines_equal_brute_force(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(120):
        lines = [" ".join(rng.choice(["a", "b", "7", "8"], rng.integers(4, 12), p=[0.5, 0.1, 0.3, 0.1])) for _ in range(4)]
        rows.append((k, "\n".join(lines)))
    lines = [(d, n, x.split()) for d, text in rows for n, x in enumerate(text.split("\n"))]

    def match(a, b, masked):
        if len(a) != len(b):
            return False
        x, y = ([["<*>" if masked and t in "78" else t for t in z] for z in (a, b)])
        n, w = len(a), len(a) // 5
        runs = [(0, 0)] + [(3 + k * w, min(n, 3 + k * w + w)) for k in range(-(-(n - 3) // w) if w else 0)]
        for low, high in runs:
            if x[:low] == y[:low] and x[high:] == y[high:]:
                constant = sum(t not in "78" for t in a[:low] + a[high:])
                if (constant >= 3 and 2 * constant >= n) or (not masked and low == high):
                    return True
        return False

    def by(masked):
        return {(d, n) for d, n, x in lines if any(e < d and match(x, y, masked) for e, _, y in lines)}

    found = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), careful=True).collect()
    copied = {(r.doc_id, k) for r in found for k in r.copied}
    assert copied == by(False) and {(r.doc_id, k) for r in found for k in r.dropped} == by(False) | by(True) != copied
