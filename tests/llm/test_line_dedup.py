import random

from llm import line_dedup as L


def shingles(line):
    return {line[i : i + L.SHINGLE] for i in range(max(1, len(line) - L.SHINGLE + 1))}


def brute(rows):
    """(doc_id, line_no) → first place of its component, by comparing all pairs of lines."""
    places = [((i is None, i or 0, n), line.strip(" ").lower()) for i, text in rows for n, line in enumerate((text or "").split("\n"))]
    texts = sorted({t for _, t in places if t.strip()})
    sets, top = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if 100 * both >= L.THRESHOLD * (len(sets[x]) + len(sets[y]) - both):
                top[find(x)] = find(y)
    group = {t: find(x) for x, t in enumerate(texts)}
    first = {}
    for place, t in places:
        if t.strip():
            first[group[t]] = min(first.get(group[t], place), place)
    return {place: first[group[t]] if t.strip() else place for place, t in places}


def rows_of(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(["th", "on", "é", "ing", "wh", "Zu", "ß"]) for _ in range(draw.randrange(1, 5)))
    bases = [" ".join(word() for _ in range(n)) for n in (2, 4, 25, 60, 60, 120)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(draw.randrange(6)):
            words = draw.choice(bases).split(" ")
            if draw.random() < 0.5:
                words[draw.randrange(len(words))] = word()
            lines.append(draw.choice(["", " "]) + " ".join(words).upper() if draw.random() < 0.2 else " ".join(words))
        lines += [" ".join(word() for _ in range(30))] * draw.randrange(3) + ["", "  "]
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    rows = rows_of(3) + [(900, None), (901, ""), (902, "La La " * 3000), (903, "la La " * 3000 + "x"), (904, "🙂" * 40), (None, "🙂" * 40 + "\nalone of all \r")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kept int, line_no string").repartition(4)
    got = {(r.doc_id is None, r.doc_id or 0, r.line_no): ((r.first_doc_id is None, r.first_doc_id or 0, r.first_line_no), r.kept) for r in L.line_classes(df).collect()}
    expect = brute(rows)
    assert set(got) == set(expect)
    assert all(kept == (first == place) for place, (first, kept) in got.items())
    assert {p: first for p, (first, _) in got.items()} == expect
    assert sum(first != place for place, first in expect.items()) > 50


def test_texts_without_repeats(spark):
    rows = [(2, "same line of text here\nown line two\n\nsame line of text here"), (1, "Same line of text here\n"), (3, None), (None, "same line of text here"), (4, "same line of text here")]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int")
    out = L.without_repeats(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(2, "own line two\n"), (1, "Same line of text here\n"), (3, None), (None, ""), (4, "")}
    assert L.line_classes(df.limit(0)).count() == 0 and L.without_repeats(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = L.op5(spark, sf_dir).collect()
    assert len(out) == sum(len(r.text.split("\n")) for r in docs)
    seen = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        for n, line in enumerate(r.text.split("\n")):
            seen.setdefault(line.strip(" ").lower(), (r.doc_id, n))
    texts = {r.doc_id: r.text.split("\n") for r in docs}
    assert all(not r.kept for r in out if seen[t := texts[r.doc_id][r.line_no].strip(" ").lower()] != (r.doc_id, r.line_no) and t.strip())


def dropped(spark, texts):
    """Places of the lines, one a document, that an earlier one replaces."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in L.line_classes(df).collect() if not r.kept}


def test_tails_count(spark):
    texts = ["The result was 17", "The result was 18", "Figure 1 shows the results for group A", "Figure 1 shows the results for group B", "2024-05-01 12:00:01 price 10.50", "2024-05-01 12:00:01 price 10.59", "x" * 17, "x" * 18]
    expect = {j for j, t in enumerate(texts) if any(100 * len(shingles(s) & shingles(t)) >= L.THRESHOLD * len(shingles(s) | shingles(t)) for s in texts[:j])}
    assert {1} & expect == set() and 7 in expect
    assert dropped(spark, texts) == expect


def test_near_copies_without_blanks(spark):
    draw = random.Random(5)
    line = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(n))
    texts, expect = [], set()
    for _ in range(60):
        text = line(200)
        texts += [text, "x" + text, text[:190] + line(1) + text[190:], line(1) + text + line(10)]
        expect |= {len(texts) - i for i in (1, 2, 3)}
    assert dropped(spark, texts) == expect


def test_candidates_at_the_threshold():
    """Of the SKETCH smallest hashes of a union each is shared at 0.8: no two next to each other."""
    t, apart = L.THRESHOLD / 100, [1.0, 1.0]
    while len(apart) <= L.SKETCH:
        apart.append((1 - t) * apart[-1] + t * (1 - t) * apart[-2])
    assert apart[L.SKETCH] < 1e-6


def test_marks_rule_out_no_similar_pair(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(1, 9)))
    lines = []
    for n in (3, 20, 200, 900):
        base = [word() for _ in range(n)]
        for edits in range(0, 12):
            own = list(base)
            for _ in range(edits * n // 60 + edits % 3):
                own[draw.randrange(n)] = word()
            lines.append(" ".join(own))
    lines = sorted(set(lines))
    marks = L.marks_of(spark.createDataFrame(list(enumerate(lines)), "node long, norm string"))
    pairs = spark.createDataFrame([(a, b) for b in range(len(lines)) for a in range(b)], "a long, b long")
    passed = {tuple(r) for r in L.likely_pairs(pairs, marks).collect()}
    sets = [shingles(t) for t in lines]
    reach = lambda p, percent: 100 * len(sets[p[0]] & sets[p[1]]) >= percent * len(sets[p[0]] | sets[p[1]])
    every = [(a, b) for b in range(len(lines)) for a in range(b)]
    assert {p for p in every if reach(p, L.THRESHOLD)} <= passed
    assert all(reach(p, 70) for p in passed if len(sets[p[0]]) < 1000)


def test_rounds(spark, monkeypatch):
    """A common passage in lines that are alike in groups: many lines a bucket, one partner a round, blocks cut into parts."""
    from llm import linking

    monkeypatch.setattr(L, "PARTNERS", 1)
    monkeypatch.setattr(L, "MORE", 2)
    monkeypatch.setattr(linking, "BLOCK", 16)
    draw = random.Random(13)
    text = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    shared, rows = text(60), []
    for _ in range(12):
        base = text(120)
        for _ in range(8):
            at = draw.randrange(110)
            rows.append(shared + base[:at] + text(draw.randrange(1, 12)) + base[at + 6 :])
    draw.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    expect = brute(list(enumerate(rows)))
    got = {(False, r.doc_id, r.line_no): (False, r.first_doc_id, r.first_line_no) for r in L.line_classes(df).collect()}
    assert got == expect and 12 <= len(set(expect.values())) < 96


def test_repeated_ids_and_names(spark):
    """Rows with the same id are documents of their own; columns may be called as those used inside."""
    rows = [(3, "the first text of all the rows", "a"), (5, "the first text of all the rows", "b"), (5, "a text that occurs just once here", "c"), (5, "a text that occurs just once here", "d"), (9, "something else altogether", "e"), (None, "something else altogether", "f"), (None, "and one more without an id", "g")]
    df = spark.createDataFrame([(i, t, 1, x, x, x) for i, t, x in rows], "doc_id long, text string, node int, `row` string, gone string, digest string")
    out = L.without_repeats(df)
    assert out.columns == df.columns
    texts = {r["row"]: r.text for r in out.collect()}
    assert texts == {"a": rows[0][1], "b": "", "c": rows[2][1], "d": rows[3][1], "e": rows[4][1], "f": "", "g": rows[6][1]}
    clash = df.withColumnRenamed("node", "_id").withColumnRenamed("gone", "_drop")
    assert L.line_classes(clash).count() == 7 and L.without_repeats(clash).count() == 7


def test_near_copy_without_id(spark):
    line = "a line of some length that is found once more with a slight change near its very end, {}"
    df = spark.createDataFrame([(None, line.format("x")), (7, line.format("y"))], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id, r.kept) for r in L.line_classes(df).collect()} == {(7, 7, True), (None, 7, False)}


def test_marks_cut_every_line_once(spark, monkeypatch):
    plans = []
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(L, "stage", lambda df, label: plans.append(plan(df)) or df)
    texts = spark.range(9).selectExpr("id AS node", "repeat(CAST(id AS STRING), 30) AS norm")
    L.marks_of(texts)
    assert plans[0].count("sequence(") == plan(texts.select(L.shingles(texts["norm"]).alias("x"))).count("sequence(")


def test_no_components_without_links(spark, monkeypatch):
    """Lines that meet in buckets and pass the marks, but do not reach the threshold: what is known of components stays as it is."""
    from llm.linking import components

    draw, labels, stage = random.Random(21), [], L.stage
    text = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    base = text(295)
    rows = [base[:at] + "#" + base[at + 1 :] for at in range(20, 270, 30)]
    monkeypatch.setattr(L, "stage", lambda df, label: labels.append(label) or stage(df, label))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(L, "components", lambda edges, label: labels.append(f"components of {edges.count()}") or components(edges, label))
    expect = brute(list(enumerate(rows)))
    got = {(False, r.doc_id, r.line_no): (False, r.first_doc_id, r.first_line_no) for r in L.line_classes(df).collect()}
    assert got == expect
    later = labels[labels.index("op5-round") :]
    assert later.count("op5-edges") >= 1 and "components of 0" not in later


def test_characters_of_two_and_four_bytes(spark):
    """A shingle has one hash, in a line of short characters as in one that holds a long one; neither bytes nor halves of characters meet."""
    draw = random.Random(4)
    line = "".join(chr(draw.randrange(0x61, 0x7B)) for _ in range(100)) + "é中" + "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(80))
    rows = [(1, line), (2, line + "🙂"), (3, line[:90] + "🙂" * 2 + line[90:]), (4, "🙂" + line[1:]), (5, "😀" * 20), (6, "🙂" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(False, r.doc_id, r.line_no): (False, r.first_doc_id, r.first_line_no) for r in L.line_classes(df).collect()}
    assert got == brute(rows) and len(set(got.values())) < 6
    sizes = df.select(L.F.size(L.F.array_distinct(L.shingles(L.F.col("text")))).alias("n"), "text").collect()
    assert all(r.n == len(shingles(r.text)) for r in sizes)


def test_blank_lines(spark):
    """Blank is what holds nothing but blanks and control white space; a single mark of a line's end after them counts as that."""
    lines = ["", "  ", "\t\x0b\x0c\r", " \t \t", "\x85", "\t\u2028", "\u2029", "\u00a0", "a", "\u2028\u2028"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    old = L.F.trim(L.F.lower("line"))
    rows = L.lines_of(df).join(df.withColumnRenamed("text", "line"), "doc_id").select("norm", L.F.when(~old.rlike(r"^[\x09-\x0D]*$"), old).alias("old")).collect()
    assert len(rows) == len(lines) and all(r.norm == r.old for r in rows)
