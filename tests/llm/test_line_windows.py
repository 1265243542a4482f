import random

from docvet.llm import line_windows as W


def brute(rows, size=3, least=8):
    """Removed line numbers of each distinct (id, text), in the order of the ids."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = W.split_lines(t)
        real = [k for k, x in enumerate(lines) if x.strip()]
        covered = []  # runs of places among the lines that aren't blank
        for k in range(len(real) - size + 1):
            window = tuple(lines[real[k + j]].strip().lower() for j in range(size))
            if window in seen:
                if covered and k <= covered[-1][-1]:
                    covered[-1] += range(covered[-1][-1] + 1, k + size)
                else:
                    covered.append(list(range(k, k + size)))
            seen.add(window)
        words = lambda x: max(x.strip().count(" ") + 1, sum("\u3400" <= c <= "\u9fff" for c in x) // 2)
        out[i, t] = sorted(real[k] for run in covered if sum(words(lines[real[k]]) for k in run) >= least for k in run)
    return out


def test_equals_brute_force(spark, make_docs, odd_rows, monkeypatch):
    rng = random.Random(4)
    pool = [" ".join(f"p{rng.randrange(30)}" for _ in range(rng.randrange(1, 7))) for _ in range(25)]
    rows = [r for r in odd_rows if r[0] not in (9, None)]
    rows += [(1000 + k, rng.choice(("\n", ". ", "\n\n")).join(rng.choices(pool, k=rng.randrange(1, 40)))) for k in range(60)]
    rows += rows[-5:]  # rows that are there twice
    want = brute(rows)
    got = W.remove_repeats(make_docs(rows)).collect()
    assert len(got) == len(rows) and sum(map(len, want.values())) > 50
    texts = dict(((i, tuple(g)), "") for (i, _), g in want.items())
    for r in got:
        matches = [(t, g) for (i, t), g in want.items() if i == r.doc_id and g == r.removed]
        assert any(r.text == (t if t is None else "".join(x for k, x in enumerate(W.split_lines(t)) if k not in set(g))) and r.lines == len(W.split_lines(t)) for t, g in matches), r.doc_id
    assert len(texts) >= len({i for i, _ in want})


def test_blocks_and_empty(spark, make_docs, monkeypatch):
    passage = "The first sentence stands here. Then a second one follows. And a third one ends it. "
    rows = [(k, f"Only in {k}. {passage}Tail {k}.") for k in range(50)]
    kept = {r.doc_id: r.text for r in W.remove_repeats(make_docs(rows)).collect()}
    assert passage in kept[0] and all(kept[k] == f"Only in {k}. Tail {k}." for k in range(1, 50))
    docs = make_docs(rows)
    assert W.remove_repeats(docs.where("false")).count() == 0
    assert W.remove_repeats(docs).columns == [c for c in docs.columns if c not in ("lines", "removed")] + ["lines", "removed"]


def test_runs_of_short_lines(spark, make_docs):
    """Verse, single words and a script without spaces: no window has eight words, the passages have; a short meeting stays."""
    verse = "\n".join(f"a{k} b{k}" for k in range(30)) + "\n"
    shout = "".join(f"WORD{k}!! " for k in range(60))
    dense = "\n".join("".join(chr(0x4E00 + 97 * k + j) for j in range(9)) for k in range(5)) + "\n"
    rows = []
    for k, passage in enumerate((verse, shout, dense, "yes\nno\nmaybe\n")):
        rows += [(10 * k + j, f"own start {k} {j}\n{passage}own end {k} {j}") for j in (1, 2)]
    got = {r.doc_id: r.text for r in W.remove_repeats(make_docs(rows)).collect()}
    assert [got[10 * k + 2] for k in range(3)] == [f"own start {k} 2\nown end {k} 2" for k in range(3)]
    assert all(got[i] == t for i, t in rows if i % 10 == 1 or i > 30)


def test_own_names_for_the_new_columns(spark, make_docs):
    docs = make_docs([(1, "a\nb\nc"), (2, "a\nb\nc")])
    got = W.remove_repeats(docs, lines_col="n_lines", removed_col="gone")
    assert got.columns == [*docs.columns, "n_lines", "gone"] and {r["lines"] for r in got.collect()} == {r["lines"] for r in docs.collect()}
