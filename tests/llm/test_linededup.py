from lexiloom.llm import linededup

SCHEMA = "doc_id long, text string, pos int, w string"


def brute(rows, size=3):
    seen, out = {}, []
    order = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None})
    gone = {}
    for i, t in order:
        lines = t.split("\n")
        for p in range(len(lines) - size + 1):
            w = "\n".join(lines[p : p + size])
            if w.strip() and seen.setdefault(w, (i, t, p)) != (i, t, p):
                gone.setdefault((i, t), set()).update(range(p, p + size))
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        cut = gone.get((i, t), set())
        out.append((i, len(lines), len(cut), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in cut)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    block = "one\ntwo\nthree\nfour\nfive"
    rows = [(1, f"a\n{block}\nb"), (2, f"x\n{block}"), (3, block), (4, "one\ntwo"), (5, "same\n" * 9), (6, "\n\n\n\n\n"), (7, "\n\n\n"), (8, None), (9, ""), (None, block), (3, block), (10, f"three\nfour\nfive\n{block}"), (11, "q\n" * 2000 + block)]
    rows += [(100 + k, f"head {k}\nlicence line\nlicence more\nlicence end\ntail {k}") for k in range(50)]
    rows = [(*r, 1, "") for r in rows]
    out = linededup.dedup_lines(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["n_lines"], len(r["removed"]), r["kept_text"]) for r in out), key=str) == brute(rows)
    assert out[0].asDict().keys() >= {"pos", "w"}


def test_empty(spark):
    assert linededup.dedup_lines(spark, spark.createDataFrame([], SCHEMA)).count() == 0
