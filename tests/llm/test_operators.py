"""Edge cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratadoc.llm import knn_perm, leak_search, neardup, packing, page_repair, pair_defects, reading_level, segment, wordscan

random.seed(7)
VOCABULARY = [f"{a}{b}" for a in ("be", "do", "fa", "gu", "ki", "lo", "mi", "nu", "po", "ra") for b in ("ck", "ll", "nt", "rd", "st", "mp", "sh", "ve")]


def words(n, seed=None):
    pick = random.Random(seed) if seed is not None else random
    return [pick.choice(VOCABULARY) + str(pick.randint(0, 40)) for _ in range(n)]


# Near-duplicates


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, text string").withColumns({"k1": F.lit("clash"), "bands": F.lit(1), "text_a": F.lit("x")})


def test_near_duplicates_against_all_pairs(spark):
    rows = []
    for g in range(12):
        base = words(120, g)
        rows.append((f"a{g}", " ".join(base)))
        for e in (0, 4, 14, 40):
            edited = list(base)
            for i in random.sample(range(len(base)), e):
                edited[i] = f"edit{random.randint(0, 9999)}"
            rows.append((f"b{g}_{e}", " ".join(edited).upper() + " ."))
    rows += [("a0", rows[0][1]), ("null", None), ("empty", ""), ("two", "only two"), (None, "a b c d e"), ("s1", "one two three"), ("s2", "One, two THREE!")]
    found = neardup.NearDuplicates(chunk_rows(spark, rows), threshold=neardup.LOOSE, exact=0.5)
    got = {(r.id_a, r.id_b): r.jaccard for r in found.pairs().collect()}
    sets = {}
    for k, t in rows:
        w = "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()
        if k and len(w) >= 3:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    ids = sorted(sets)
    exact = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    exact = {k: v for k, v in exact.items() if v >= 0.5}
    assert set(got) <= set(exact) and all(abs(got[k] - exact[k]) < 1e-9 for k in got)
    assert len(got) >= 0.97 * len(exact) and ("s1", "s2") in got
    groups = {r.id: r.group_id for r in found.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got) and set(groups) == set(ids)


def test_edits_of_a_hot_text_are_found(spark):
    core = words(60, 3)
    rows = [(f"h{i:03}", " ".join([*core, *(f"tail{i}x{j}" for j in range(29))])) for i in range(150)]
    rows += [(f"o{i:03}", " ".join(f"other{i}x{j}" for j in range(80))) for i in range(300)]
    found = {(r.id_a, r.id_b): r.jaccard for r in neardup.NearDuplicates(chunk_rows(spark, rows), threshold=neardup.LOOSE, exact=0.5).pairs().collect()}
    assert all(a[0] == b[0] == "h" and abs(j - 0.5) < 1e-9 for (a, b), j in found.items())
    assert len(found) >= 0.98 * 150 * 149 / 2


def weighted_jaccard(texts, pair):
    """By its definition: counts times ln(1 + 1 / share of texts), shares between 1/1024 and 1/100."""
    split = [t.split() for t in texts]
    counts = [Counter(zip(w, w[1:], w[2:])) for w in split]
    held = Counter(s for c in counts for s in c)
    a, b = (counts[i] for i in pair)
    weight = {s: np.log1p(1 / min(max(held[s] / len(texts), 1 / 1024), 1 / 100)) for s in {*a, *b}}
    return sum(weight[s] * min(a[s], b[s]) for s in weight) / sum(weight[s] * max(a[s], b[s]) for s in weight)


def test_the_weighted_similarity_decides(spark):
    common = words(42, 11)  # one text of twenty begins with this, so it weighs less than what is in one text only
    rows = [(f"c{i:02}", " ".join(common + words(30, 200 + i))) for i in range(20)] + [(f"o{i:03}", " ".join(words(70, 300 + i))) for i in range(376)]
    base = words(60, 12)
    rows += [("x", " ".join(base + words(20, 13))), ("y", " ".join(base + words(20, 14))), ("z", " ".join(words(20, 15) * 3 + ["end"])), ("zz", " ".join(words(20, 15) * 2))]
    got = {t: {(r.id_a, r.id_b): r for r in neardup.NearDuplicates(chunk_rows(spark, rows), threshold=t).pairs().collect()} for t in (0.3, 0.37, 0.5)}
    place = {k: i for i, (k, _) in enumerate(rows)}
    for (a, b), r in got[0.3].items():
        assert abs(r.weighted_jaccard - weighted_jaccard([t for _, t in rows], (place[a], place[b]))) < 1e-9
    alike = [r for r in got[0.3].values() if r.id_a[0] == r.id_b[0] == "c"]
    assert len(alike) > 150 and all(r.jaccard > 0.37 > r.weighted_jaccard for r in alike)  # alike as sets, not by weight
    assert not any(a[0] == "c" for a, _ in got[0.37]) and ("x", "y") in got[0.5] and set(got[0.5]) <= set(got[0.37])
    assert got[0.5]["z", "zz"].jaccard > 0.9 > 0.7 > got[0.5]["z", "zz"].weighted_jaccard  # how often a shingle stands there counts


def test_unlike_texts_are_not_compared(spark, monkeypatch):
    pick = random.Random(21)
    phrases = [" ".join(words(5, 1000 + i)) for i in range(120)]
    rows = [(f"u{i:04}", " ".join(pick.choices(phrases, k=20))) for i in range(1500)]
    rows += [(f"{k}x", t + " one more line") for k, t in rows[:20]]
    compared, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    for sets in (1 << 20, 1000):  # bands of three samples and of four
        monkeypatch.setattr(neardup, "SETS", sets, raising=False)
        found = {(r.id_a, r.id_b) for r in neardup.NearDuplicates(chunk_rows(spark, rows), threshold=neardup.LOOSE, exact=0.5).pairs().collect()}
        assert found == {(f"u{i:04}", f"u{i:04}x") for i in range(20)}
    assert compared[0] <= 200 and compared[1] <= 40, compared


def test_longer_bands_for_more_texts(spark):
    assert [neardup.band_rows(n) for n in (0, 1, 1 << 20, 4_000_000, 1 << 25, 1 << 26)] == [3, 3, 3, 4, 4, 5]
    for rows in (3, 4):
        bands = [set(x) for x in neardup.lines(neardup.BANDS, rows).tolist()]
        assert all(len(x) == rows for x in bands) and all(len(x & y) < 2 for i, x in enumerate(bands) for y in bands[:i])
    rows = []
    for g in range(30):
        base = words(100, 400 + g)
        rows += [(f"l{g:02}", " ".join(base)), (f"m{g:02}", " ".join(base[:78] + words(22, 500 + g)))]
    for n in neardup.SLOPES:
        found = neardup.NearDuplicates(chunk_rows(spark, rows), threshold=neardup.LOOSE, exact=0.5, rows=n).pairs().collect()
        assert len({(r.id_a, r.id_b) for r in found} & {(f"l{g:02}", f"m{g:02}") for g in range(30)}) >= 29


def test_near_duplicates_of_nothing(spark):
    found = neardup.NearDuplicates(chunk_rows(spark, []))
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_many_copies_are_one_set(spark):
    text = " ".join(words(60, 1))
    found = neardup.NearDuplicates(chunk_rows(spark, [(f"c{i}", text) for i in range(40)] + [("d", text + " more words here")]))
    assert found.links.count() == 1 and found.pairs().count() == 41 * 40 // 2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "x bigint, y bigint")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# Vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<float>").withColumns({"class": F.lit(1), "group": F.lit(2), "neighbour": F.lit("x")})


def exact_neighbours(rows, k=5):
    ids = sorted({i for i, v in rows if i and v and any(v)})
    x = np.array([next(v for i, v in rows if i == k2 and v) for k2 in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(x @ x.T, 9)
    np.fill_diagonal(near, -9)
    return {(a, ids[j]) for i, a in enumerate(ids) for j in np.lexsort((np.arange(len(ids)), -near[i]))[: min(k, len(ids) - 1)]}


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    rows = [(f"v{i:04}", (centres[i % 60] + 0.5 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    got = {(r.id, r.neighbour) for r in knn_perm.most_similar(vectors(spark, rows), group_rows=400).collect()}
    exact = exact_neighbours(rows)
    assert len(got) == len(exact) == 15_000 and len(got & exact) >= 0.9 * len(exact)


def test_recall_among_many_groups(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(700, 96))
    rows = [(f"v{i:04}", (centres[i % 700] + 0.5 * rng.normal(size=96)).astype(np.float32).tolist()) for i in range(4900)]
    assert knn_perm.reach(20) == (8, 3) and knn_perm.reach(1000) == (33, 8)
    got = {(r.id, r.neighbour) for r in knn_perm.most_similar(vectors(spark, rows), group_rows=25).collect()}
    exact = exact_neighbours(rows)
    assert len(got & exact) >= 0.88 * len(exact)


def test_groups_are_halved_where_pivots_are_few(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    rows = [(f"v{i:04}", (centres[i % 40] + 0.4 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(4000)]
    assert knn_perm.halves(8, 4000, 100) == 3 and knn_perm.halves(8, 4000, 4000) == 0
    got = {(r.id, r.neighbour) for r in knn_perm.most_similar(vectors(spark, rows), group_rows=100, most_pivots=8).collect()}
    exact = exact_neighbours(rows)
    assert len(got) == len(exact) and len(got & exact) >= 0.8 * len(exact)
    rows = [(f"t{i:02}", [float(i + 1), 2.0 * (i + 1)]) for i in range(20)] + [("u", [1.0, 0.0])]
    tied = {(r.id, r["rank"]): r.neighbour for r in knn_perm.most_similar(vectors(spark, rows)).collect()}
    assert [tied["t19", k] for k in range(1, 6)] == ["t00", "t01", "t02", "t03", "t04"]


def test_ties_copies_and_unusable_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(f"c{i}", same) for i in range(9)] + [("far", [3.0, -1.0, 0.5]), ("scaled", [2.0, 4.0, 6.0]), ("zero", [0.0] * 3), ("null", None), ("short", [1.0]), ("nan", [float("nan")] * 3), (None, same), ("c0", same)]
    got = {}
    for r in knn_perm.most_similar(vectors(spark, rows)).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    assert set(got) == {*(f"c{i}" for i in range(9)), "far", "scaled"}
    assert [got["c0"][k] for k in range(1, 6)] == ["c1", "c2", "c3", "c4", "c5"]
    assert [got["c8"][k] for k in range(1, 6)] == ["c0", "c1", "c2", "c3", "c4"]
    assert got["scaled"][1] == "c0"


def test_few_or_no_vectors(spark):
    assert knn_perm.most_similar(vectors(spark, [])).count() == 0
    assert knn_perm.most_similar(vectors(spark, [("a", None)])).count() == 0
    two = knn_perm.most_similar(vectors(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])])).collect()
    assert {(r.id, r.neighbour) for r in two} == {("a", "b"), ("b", "a")}


# Segmentation


def blocks(spark, rows):
    return spark.createDataFrame(rows, "block_id bigint, kind string, text string").withColumns({"piece": F.lit("clash"), "n_words": F.lit(0)})


def test_pieces_come_together_again(spark):
    texts = [" ".join(w + ("." if random.random() < 0.1 else "") + ("\n\n" if random.random() < 0.02 else "") for w in words(n)) for n in (221, 500, 2600)]
    texts += ["x " * 221, " ".join(words(300)), "a" * 50_000 + " " + "b " * 400]
    rows = [(i, " BODY ", t) for i, t in enumerate(texts)] + [(90, "body", None), (91, "body", ""), (92, None, "w " * 300), (93, "heading", "w " * 300), (94, "body", "w " * 220), (0, " BODY ", texts[0])]
    got = {}
    for r in segment.split_oversized(blocks(spark, rows)).distinct().collect():
        got.setdefault(r.block_id, {})[r.piece_index] = r
    over = {i for i, t in enumerate(texts) if len(t.replace("\n", " ").split(" ")) - t.replace("\n", " ").split(" ").count("") > 220}
    assert set(got) == over and 4 not in got
    for i, pieces in got.items():
        back = []
        for k in range(len(pieces)):
            p = pieces[k]
            own = [w for w in p.piece.replace("\n", " ").split(" ") if w]
            assert len(own) == p.n_words <= 220 and p.overlap_words <= 50 and own[: p.overlap_words] == back[len(back) - p.overlap_words :]
            back += own[p.overlap_words :]
        assert back == [w for w in texts[i].replace("\n", " ").split(" ") if w]


def test_a_change_of_topic_is_cut(spark):
    topic = lambda names, n: " ".join(f"{random.choice(names)} {random.choice(names)} {random.choice(names)} {random.choice(names)}." for _ in range(n))
    text = topic(["road", "lane", "curb"], 40) + "\n\n" + topic(["pipe", "drain", "pump"], 40)
    first = segment.cut_text(text)[0]
    assert first["n_words"] == 160
    with pytest.raises(ValueError):
        segment.cut_text("a", 10, 10)


# Defects


SOUND = "- The depth of the wall is {} mm along both edges.\n- The lane shall be sealed before each shift.\n^^^1^^^"


def test_defects(spark):
    sound = [(i, f"What is the depth of the wall number {i}?", SOUND.format(i)) for i in range(60)]
    spanish = [(100 + i, "¿Cuál es el valor mínimo para la zanja de drenaje?", "- La zanja de drenaje debe resistir una carga de 9 kN cuando la estructura queda sumergida.\n^^^1^^^") for i in range(10)]
    bad = {
        200: ("q", None, "empty"), 201: ("q", " ​", "empty"), 202: ("q", "- \n^^^3^^^\n- ", "empty"), 203: (None, "n/a", "empty"), 204: ("q", "<think>x</think>", "empty"),
        210: ("What is the depth?", "I'm sorry, but I can't help with that.", "refusal"), 211: ("What?", "^^^FAIL^^^", "refusal"), 212: ("What?", "Je suis désolé, je ne peux pas répondre.", "refusal"),
        220: ("What is the depth of the wall?", "WHAT IS THE DEPTH OF THE WALL?", "echo"), 221: ("What is the depth of the wall?", "The question is: \"what is the depth of the wall\"", "echo"),
        230: ("What is the depth of the wall?", spanish[0][2], "language"), 240: ("What is the depth of the wall?", "- The depth of the wall is 5 mm along both edges.\n- The lane shall be", "truncated"), 241: ("What is it?", "- The depth of the wall is 5 mm.\n^^^1^^", "truncated"),
        250: ("Respond in Spanish. What is the depth?", spanish[0][2], None), 251: ("Can it be sealed?", "Yes.", None), 252: ("What is the depth of the wall?", "- The depth is 3 mm.\n^^^1^^^\nThe provided standards do not address other parts.\n^^^FAIL^^^", None),
        260: ("What is the slope?", "The slope is 2 percent. Nothing in the documents conflicts with this.", None), 261: ("What is the slope?", "I am sorry the text is long, the slope is 2 percent.", None),
        262: ("What is the slope?", "It seems best that nobody here tries to respond to such a thing without a survey.", None), 263: ("What is the slope?", "My instructions leave me no way to reply to that one.", "refusal"),
        264: ("What is the depth of the outer wall?", "what is the outer depth of the wall", "echo"), 265: ("What is the depth of the outer wall?", "The depth of the outer wall is 31 mm along both edges.", None),
        256: ("Can it be sealed?", "No.", None), 257: ("What is the depth of the wall?", "> What is the depth of the wall?", "echo"),
        253: (None, SOUND.format(7), None), 254: ("", SOUND.format(7), None), 255: ("What is the depth of the wall?", SOUND.format(7) * 3000, None),
    }
    rows = sound + spanish + [(k, q, r) for k, (q, r, _) in bad.items()] + [(200, "q", None)]
    df = spark.createDataFrame(rows, "log_id bigint, query string, response string").withColumns({"defect": F.lit("clash"), "model": F.lit(1)})
    got = {r.log_id: r.defect for r in pair_defects.defective_pairs(df).collect()}
    assert got == {k: d for k, (_, _, d) in bad.items() if d}


def test_no_pairs(spark):
    df = spark.createDataFrame([], "log_id bigint, query string, response string")
    assert pair_defects.defective_pairs(df).count() == 0


# Page repair


def page(i, body):
    return f"Field Handbook   {i}\n\n{body}\n- {i} -"


def test_page_repair(spark):
    clean = "the retaining wall beside the shared-use path shall be inspected before each shift. every culvert must be replaced by a qualified crew at regular intervals. section 12.4(3) holds."
    rows = [(i, "clean.pdf", clean, i, str(i), "1.1", 10.0, "Roman") for i in range(1, 31)]
    pages = {
        1: "Every culvert must be re-\nplaced by a qualified crew. The retaining vvall\nbeside the shared-\nuse path shall be in-",
        2: "spected before each shift. The cu1vert holds 4O\nintervals.",
        3: "Every culvert must be replaced.",
    }
    rows += [(100 + i, "scan.pdf", page(i, t), i, "4O" if i == 1 else "3", "12.I4(3)" if i == 2 else "UNKNOWN", 0.0, "") for i, t in pages.items()]
    rows += [(201, "other.pdf", None, 1, None, None, 0.0, ""), (202, "other.pdf", "", None, "UNKNOWN", "", 0.0, ""), (103, "scan.pdf", page(3, pages[3]), 3, "3", "UNKNOWN", 0.0, "")]
    df = spark.createDataFrame(rows, "block_id bigint, source_file string, text string, page int, doc_page string, section string, font_size double, font_name string").withColumns({"headers": F.lit(1), "rest": F.lit("x")})
    chunks = spark.createDataFrame([("c1", "Section 1S"), ("c1", "Section 1S"), ("c2", None), ("c3", "6D.58")], "id string, section string")
    repair = page_repair.PageRepair(df, chunks)
    got = {tuple(r) for r in repair.noise().collect()}
    lines = {(f"10{i}", 1, "running_header") for i in pages} | {("101", 7, "page_number"), ("102", 5, "page_number"), ("103", 4, "page_number")}
    assert got == lines | {
        ("101", 3, "hyphen"), ("101", 4, "misread"), ("101", 6, "hyphen"), ("102", 3, "misread"), ("101", 0, "doc_page"), ("102", 0, "section"), ("c1", 0, "section"),
    }
    text = {r.record_key: r.text for r in repair.paragraphs().collect() if r.paragraph == 0}
    assert text["101"].startswith("Every culvert must be replaced by a qualified crew. The retaining wall beside the shared-use path shall be inspected")
    assert "The culvert holds 40" in text["102"]


def test_paragraphs_go_on_over_page_breaks(spark):
    clean = "the retaining wall beside the shared use path shall be inspected before each shift. every culvert must be replaced by a qualified crew at regular intervals."
    rows = [(i, "clean.pdf", clean, i, 10.0, "Roman") for i in range(1, 31)]
    pages = {
        1: "Every culvert must be replaced.\n\nThe retaining wall beside the shared use path\nshall be inspected before each shift by a",
        2: "qualified crew at regular intervals and every\nculvert must be replaced before each shift by a",
        3: "qualified crew.\n\nEvery culvert must be inspected at regular in-",
        4: "tervals.\n\nThe retaining wall must be replaced.",
        5: "Every culvert must be inspected.",
        7: "before each shift by a qualified crew.",
    }
    rows += [(100 + i, "scan.pdf", page(i, t), i, 0.0, "") for i, t in pages.items()] + [(203, "scan.pdf", page(3, pages[3]), 3, 0.0, ""), (300, "other.pdf", pages[2], None, 0.0, ""), (400, None, pages[5], 5, 0.0, "")]
    df = spark.createDataFrame(rows, "block_id bigint, source_file string, text string, page int, font_size double, font_name string").withColumns({c: F.lit("UNKNOWN") for c in ("doc_page", "section")})
    repair = page_repair.PageRepair(df, spark.createDataFrame([], "id string, section string"))
    got = sorted((r.record_key, r.paragraph, r.text) for r in repair.continuous().collect())
    whole = "Every culvert must be inspected at regular intervals."
    assert got == [
        ("101", 0, "Every culvert must be replaced."),
        ("101", 1, "The retaining wall beside the shared use path shall be inspected before each shift by a qualified crew at regular intervals and every culvert must be replaced before each shift by a qualified crew."),
        ("103", 0, whole), ("104", 0, "The retaining wall must be replaced."), ("105", 0, "Every culvert must be inspected."), ("107", 0, "before each shift by a qualified crew."),
        ("203", 0, whole), ("300", 0, "qualified crew at regular intervals and every culvert must be replaced before each shift by a"), ("400", 0, "Every culvert must be inspected."),
    ]
    assert repair.continuous().columns == ["record_key", "paragraph", "text"]


def test_headers_that_change_by_chapter(spark):
    clean = "the retaining wall beside the shared use path shall be inspected before each shift."
    rows = [(i, "clean.pdf", clean, i, 10.0, "Roman") for i in range(1, 31)]
    chapter = lambda i: "Drainage and Culverts" if 117 <= i < 123 else "Ramp Landings" if i in (200, 201) else "Only Once" if i in (20, 90, 160) else None
    rows += [(1000 + i, "scan.pdf", (f"{chapter(i)}\n" if chapter(i) else "") + f"The wall {words(6, i)} shall be inspected.\n{i}", i, 0.0, "") for i in range(1, 301)]
    df = spark.createDataFrame(rows, "block_id bigint, source_file string, text string, page int, font_size double, font_name string").withColumns({c: F.lit("UNKNOWN") for c in ("doc_page", "section")})
    noise = page_repair.PageRepair(df, spark.createDataFrame([], "id string, section string")).noise()
    got = {(r.record_key, r.line_no) for r in noise.filter("noise = 'running_header'").collect()}
    assert got == {(str(1000 + i), 1) for i in [*range(117, 123), 200, 201]}


def test_a_long_paragraph_is_not_cut():
    lines = ["Every culvert must be inspected."] + [""] + ["The wall beside the shared use path"] + ["and the wall beside the shared use path"] * 400
    assert page_repair.paragraph_starts(lines, [])[0] == {0, 2}
    rng = random.Random(5)
    for _ in range(200):  # against every way to break
        lines = [rng.choice(["", "The wall stands.", "the wall beside it", "The wall beside the path is", "of it."]) for _ in range(9)]
        full = [i for i, x in enumerate(lines) if x]
        if full:
            got = page_repair.paragraph_starts(lines, [])[0]
            assert cost_of(lines, full, got) == min(cost_of(lines, full, {full[0], *(x for k, x in enumerate(full[1:]) if ways >> k & 1)}) for ways in range(1 << (len(full) - 1)))


def cost_of(lines, full, starts):
    width, total = max(map(len, lines)), 0.0
    for a, b in zip(full, full[1:]):
        ends, begins = lines[a].endswith("."), lines[b][0].isupper()
        on = 5.0 * (b - a > 1) + 2.0 * (len(lines[a]) < 0.75 * width and ends)
        total += 1.0 + 3 * (not ends) + 2 * (not begins) if b in starts else on
    return total + 0.5 * sum(b in starts and (k + 1 == len(full) or full[k + 1] in starts) for k, b in enumerate(full))


def read(lines, counts):
    lexicon = page_repair.Lexicon([(w, n, 0) for w, n in counts.items()])
    tokens = page_repair.stream(lines.split("\n"), [])
    found = page_repair.decode(tokens, lexicon)
    return " ".join(r.text for r in found), sorted({tokens[k].line for r in found for k in r.misread}), sorted(tokens[r.first].line for r in found if r.hyphen)


def test_the_lattice_takes_errors_together():
    known = {"the": 900, "retaining": 90, "wall": 200, "culvert": 80, "inspected": 70, "be": 500, "shall": 400, "reinforced": 60, "concrete": 60, "right-of-way": 40, "in": 700, "side": 50}
    cases = {
        "the retaining wall": ("the retaining wall", [], []),
        "theretainingwall shall": ("the retaining wall shall", [], []),  # two blanks missing
        "the re tain ing wall": ("the retaining wall", [], []),  # two blanks too many
        "the cu1 vert shall": ("the culvert shall", [0], []),  # a blank and a confusion
        "thecu1vert shall": ("the culvert shall", [0], []),
        "the rein-\nforcedconcrete wall": ("the reinforced concrete wall", [], [0]),  # a hyphen and a missing blank
        "the re-\ninforccd wall": ("the reinforced wall", [1], [0]),  # a hyphen and a confusion
        "the right-of-\nway wall": ("the right-of-way wall", [], []),
        "the vva1l shall be inspectcd": ("the wall shall be inspected", [0], []),
        "in side the wall 4O": ("in side the wall 40", [0], []),
        "Xyqqzt the wall": ("Xyqqzt the wall", [], []),
    }
    assert {k: read(k, known) for k in cases} == cases
    assert read("the " + "x1" * 40_000 + " wall", known)[0].endswith("wall")


def test_words_beyond_the_lexicon_are_known(spark):
    clean = "the retaining wall beside the shared use path shall be inspected before each shift. a barn or a bam stands here."
    rows = [(i, "clean.pdf", clean, i, 10.0, "Roman") for i in range(1, 31)] + [(40, "clean.pdf", "one antechamber with electroplating", 40, 10.0, "Roman")]
    rows += [(101, "scan.pdf", "The bam beside the antechamber wall shall be\ninspected and e1ectroplating before the e1ectro-\nplating shift.", 1, 0.0, ""), (102, "scan.pdf", None, 2, 0.0, "")]
    df = spark.createDataFrame(rows, "block_id bigint, source_file string, text string, page int, font_size double, font_name string").withColumns({c: F.lit("UNKNOWN") for c in ("doc_page", "section")})
    empty = spark.createDataFrame([], "id string, section string")
    got = [sorted(map(tuple, page_repair.PageRepair(df, empty, vocabulary=v).noise().collect())) for v in (200_000, 8)]
    assert got[0] == got[1] == [("101", 2, "hyphen"), ("101", 2, "misread")]


def test_no_pages(spark):
    blocks = spark.createDataFrame([], "block_id bigint, source_file string, text string, page int, doc_page string, section string, font_size double, font_name string")
    chunks = spark.createDataFrame([], "id string, section string")
    assert page_repair.PageRepair(blocks, chunks).noise().count() == 0


def test_labels():
    cases = {"840.I3(8)": "840.13(8)", "SC.99": "5C.99", "Chapter I9": "Chapter 19", "2A.15": None, "1310.02(13)(l)": None, "UNKNOWN": None, None: None, "Part 7": None, "iv": None, "IS8": "158", "2-3o9": "2-309", "Scction 4": "Section 4"}
    assert {k: page_repair.repaired_label(k) for k in cases} == cases


# Packing


def test_packing(spark):
    texts = [" ".join(words(random.randint(1, 900))) for _ in range(120)] + ["", None, " ".join(words(9000, 5))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id bigint, text string").withColumns({"part": F.lit("clash"), "salt": F.lit(1)})
    rows = packing.pack(df).collect()
    held, size, parts = {}, {}, {}
    for r in rows:
        held[r.container] = held.get(r.container, 0) + r.n_tokens
        size[r.container] = r.container_size
        parts.setdefault(r.doc_id, []).append(r)
    encode = packing.encoding(packing.vocabulary()).encode_ordinary
    assert all(held[c] <= size[c] for c in held) and set(size.values()) <= set(packing.SIZES)
    for i, t in enumerate(texts):
        n = len(encode(t)) if t else 0
        own = [r for r in parts[i]][: None if i else 1]
        assert sum(r.n_tokens for r in own) == n and (len(own) == 1 or n > packing.CAPACITY)
    assert sum(size.values()) <= first_fit(sorted((r.n_tokens for r in rows if r.n_tokens), reverse=True), packing.CAPACITY, packing.SIZES)
    assert all(held[c] > next((s for s in reversed(packing.SIZES) if s < size[c]), 0) for c in held)


def first_fit(lengths, capacity, sizes):
    """Room of first-fit decreasing, each container in the smallest size that holds its contents."""
    bins = []
    for n in lengths:
        k = next((i for i, b in enumerate(bins) if b + n <= capacity), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    return sum(next(s for s in sorted(sizes) if s >= b) for b in bins)


def test_plan_is_never_worse_than_first_fit():
    for seed in range(30):
        pick = random.Random(seed)
        lengths = sorted((pick.randint(1, pick.choice([40, 100])) for _ in range(pick.randint(1, 200))), reverse=True)
        histogram = {n: lengths.count(n) for n in set(lengths)}
        room = sum(s * t for _, s, t in packing.plan(histogram, 100, (25, 50, 100)))
        assert sum(lengths) <= room <= first_fit(lengths, 100, (25, 50, 100))


def test_plan_is_exact_on_any_histogram():
    for seed in range(20):
        pick = random.Random(seed)
        histogram = {n: pick.randint(1, 50) for n in pick.sample(range(1, 101), 12)}
        used = {}
        for content, size, times in packing.plan(histogram, 100, (25, 50, 100)):
            assert sum(content) <= size <= 100
            for n in content:
                used[n] = used.get(n, 0) + times
        assert used == histogram
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({3000: 1})


def test_plan_of_very_short_texts():
    for histogram in ({1: 5000}, {2: 3000, 2048: 1}, {1: 400_001, 3: 7}):
        plans = packing.plan(histogram)
        assert sum(len(content) * times for content, _, times in plans) == sum(histogram.values())
        assert sum(size * times for _, size, times in plans) < sum(n * k for n, k in histogram.items()) + packing.CAPACITY


def test_equal_lengths_are_taken_in_order(spark, monkeypatch):
    rows = [(i, "a b" if i % 3 else "a") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted((r.n_tokens, r.doc_id, r.container) for r in packing.pack(df).collect())
    assert len(got) == 9000
    for (n, _, a), (m, _, b) in zip(got, got[1:]):
        assert n != m or a <= b


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [(r.n_tokens, r.container) for r in packing.pack(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect()] == [(0, 0)]


# Leaks


def test_leaks_against_all_windows(spark):
    items = [(i, " ".join(words(random.choice([5, 11, 12, 30]), i)), " ".join(words(60, 100 + i))) for i in range(20)] + [(20, None, ""), (None, " ".join(words(40, 3)), None)]
    docs = []
    for d in range(80):
        body = words(random.randint(0, 400))
        for _ in range(random.randint(0, 3)):
            source = random.choice(items[:20])[random.choice([1, 2])].split()
            n = random.choice([11, 12, 25])
            at = random.randint(0, max(0, len(source) - n))
            body[random.randint(0, len(body)) : 0] = [w.upper() for w in source[at : at + n]]
        docs.append((d, random.choice([" ", ", ", "\n-- "]).join(body)))
    long = " ".join(words(30_000, 9)) + " " + items[3][2]
    docs += [(500, long), (501, None), (502, ""), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"n": F.lit(5), "prompt": F.lit("x")})
    tests = spark.createDataFrame(items, "n int, prompt string, reference_answer string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.n) for r in leak_search.leaks(df, tests).collect()}
    windows = {}
    for n, *texts in items:
        for t in texts:
            w = (t or "").split()
            for i in range(len(w) - 11):
                windows.setdefault(tuple(w[i : i + 12]), set()).add(n)
    exact = set()
    for d, t in docs:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        for i in range(len(w) - 11):
            exact |= {(d, n) for n in windows.get(tuple(w[i : i + 12]), ()) if n is not None}
    assert got == exact and (500, 3) in got
    assert {(r.doc_id, r.n) for r in leak_search.leaks(df, tests, block_chars=500).collect()} == exact
    assert leak_search.leaks(df, tests.limit(0)).count() == leak_search.leaks(df.limit(0), tests).count() == 0


def test_pieces_of_a_long_text_keep_every_run():
    text = " ".join(words(3000, 2))
    parts = list(wordscan.pieces(text, 12, most=200))
    runs = lambda t: {tuple(t.split()[i : i + 12]) for i in range(len(t.split()) - 11)}
    assert len(parts) > 50 and set.union(*(runs(p) for p in parts)) == runs(text)
    assert list(wordscan.pieces("x" * 1000, 12, most=10)) == ["x" * 1000]


# Reading level


def test_reading_level_on_held_out_documents(spark):
    plain, dense = ["dog", "run", "house", "blue", "tree", "play"], ["notwithstanding", "pursuant", "serviceability", "contractual", "thereof", "remediation"]
    def make(band, n=80):
        share = (band - 1) / 3
        out, line = [], 0
        while len(out) < n:
            out.append(random.choice(dense if random.random() < share else plain))
            line += 1
            if line >= 4 * band:
                out[-1] += "."
                line = 0
        return " ".join(out)

    docs = [(i, make(1 + i % 4)) for i in range(240)]
    labels = [(i, "r", 1 + i % 4) for i in range(160)] + [(0, "s", 1), (3, "s", 3), (999, "r", 2), (5, "r", 9), (None, "r", 1)]
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (902, "too short"), (903, "zz " * 50), (904, make(4, 60_000))], "doc_id bigint, text string").withColumns({"band": F.lit("clash"), "found": F.lit(0)})
    rated = spark.createDataFrame(labels, "doc_id bigint, rater string, band int")
    level = reading_level.train(df, rated)
    got = {r.doc_id: r.band for r in reading_level.reading_bands(df, level).collect()}
    assert set(got) == {*range(240), 903, 904} and got[904] == 4
    held = range(160, 240)
    assert sum(got[i] == 1 + i % 4 for i in held) >= 0.9 * len(held)
    assert reading_level.reading_bands(df.limit(0), level).count() == 0
    with pytest.raises(ValueError):
        reading_level.train(df, rated.limit(0))
