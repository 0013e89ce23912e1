from collections import Counter, defaultdict

from guardlake.llm import lines


def plain(rows):
    def order(r):
        return (r.doc_id is not None, r.doc_id or 0)

    windows, filled = defaultdict(set), {}
    for n, r in enumerate(rows):
        every = (r.text or "").split("\n")
        filled[n] = [i for i, x in enumerate(every) if x.strip(" \t\n\x0b\x0c\r")]
        for p in range(len(filled[n]) - 2):
            windows[tuple(every[i] for i in filled[n][p : p + 3])].add((order(r), r.text, p))
    out = []
    for n, r in enumerate(rows):
        every = (r.text or "").split("\n")
        gone = set()
        for p in range(len(filled[n]) - 2):
            seen = windows[tuple(every[i] for i in filled[n][p : p + 3])]
            if (order(r), r.text, p) != min(seen, key=lambda x: (x[0], x[2])):
                gone.update(filled[n][p : p + 3])
        text = "\n".join(x for i, x in enumerate(every) if i not in gone) if gone else r.text
        out.append((r.doc_id, text, len(every), len(gone)))
    return Counter(out)


def test_windows_match_plain_comparison(awkward, nothing, spark):
    got = lines.dedup_lines(awkward)
    assert got.columns == [*awkward.columns, "n_lines_", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_lines_, r.n_removed) for r in got.collect()) == plain(awkward.collect())
    assert lines.dedup_lines(nothing).count() == 0
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\nd\ny"), (3, "q\nq\nq\nq\nq"), (4, "b\nc\nd"), (5, "b\nc"), (6, "\n\n\n"), (7, "")]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.text for r in lines.dedup_lines(small).collect()}
    assert found == {1: "a\nb\nc\nd", 2: "x\n\ny", 3: "q", 4: "", 5: "b\nc", 6: "\n\n\n", 7: ""}
    assert Counter(lines.dedup_lines(small).select("doc_id", "text", "n_lines", "n_removed").collect()) == plain(small.collect())
