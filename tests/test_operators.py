"""Operators on small tables whose results are known."""

from pyspark.sql import functions as F

from foliant.operators import edits, layout, numbering, ordered, tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_runs(spark):
    runs = spark.createDataFrame([("d", 0, "x", "a"), ("d", 1, "x", "b"), ("d", 2, None, "c"), ("d", 3, None, "d"), ("d", 4, "x", "e")], "doc string, ord int, fmt string, text string")
    assert rows(ordered.merge_runs(runs, ["doc"], "ord", ["fmt"]), "ord", "text", "parts") == [(0, "ab", 2), (2, "cd", 2), (4, "e", 1)]


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, 0, "p"), (1, 5, "q"), (1, 9, "r"), (2, 1, "s")], "g int, at int, name string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50)], "g int, at int, v int")
    assert rows(ordered.asof_join(left, right, ["g"], "at", ["v"]).fillna(-1), "name", "v") == [("p", -1), ("q", 50), ("r", 50), ("s", -1)]
    assert rows(ordered.asof_join(left, right, ["g"], "at", ["v"], first_if_none=True).fillna(-1), "name", "v") == [("p", 20), ("q", 50), ("r", 50), ("s", -1)]
    ranges = spark.createDataFrame([(1, 0, 3, "A"), (1, 5, 6, "B")], "g int, s int, e int, n string")
    assert rows(ordered.range_join(left, ranges, ["g"], "at", "s", "e"), "name", "n") == [("p", "A"), ("q", "B")]


def test_intern_inherit_closure(spark):
    df = spark.createDataFrame([(1, 3, "b"), (1, 1, "a"), (1, 2, "b"), (1, 4, None)], "doc int, at int, f string")
    dim, used = ordered.intern(df, ["doc"], F.col("at"), ["f"])
    assert rows(dim.fillna("-"), "f", "shape") == [("-", 2), ("a", 0), ("b", 1)]
    assert rows(used, "at", "shape") == [(1, 0), (2, 1), (3, 1), (4, 2)]
    styles = spark.createDataFrame([(1, f"s{i}", f"s{i - 1}" if i else None, 7 if i == 0 else None, i if i == 5 else None) for i in range(13)], "doc int, style string, parent string, size int, font int")
    got = {r.style: (r.size, r.font) for r in ordered.inherit(styles, ["size", "font"], ["doc"]).collect()}
    assert got["s12"] == (7, 5) and got["s4"] == (7, None)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "src int, dst int")
    seeds = spark.createDataFrame([(0, 1)], "root int, node int")
    assert rows(ordered.closure(seeds, edges), "root", "node") == [(0, 1), (0, 2), (0, 3)]


def test_numbering(spark):
    h = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 2, 1, 2, 3, 3, 2])], "doc int, at int, level int")
    assert [r[1:] for r in rows(numbering.outline_numbers(h, ["doc"], "at"), "at", "n", "label")] == [(1, "1."), (1, "가."), (2, "나."), (2, "2."), (1, "가."), (1, "1)"), (2, "2)"), (2, "나.")]
    items = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 1, 2, 1, 0])], "doc int, at int, level int")
    assert [r[1] for r in rows(numbering.list_nesting(items, ["doc"], "at").fillna(-1), "at", "parent")] == [-1, 0, 1, 0, -1]
    b = spark.createDataFrame([(1, 0, "b4"), (1, 1, None), (1, 2, "x"), (1, 3, None)], "doc int, ord int, data_id string")
    assert rows(numbering.assign_ids(b, ["doc"], ["ord"]), "ord", "data_id") == [(0, "b4"), (1, "b5"), (2, "x"), (3, "b6")]
    assert rows(numbering.next_match(b, ["doc"], ["ord"], back=True), "k", "target") == [(0, 3), (1, 0), (2, 1), (3, 2)]


def test_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 1, "a"), (1, 0, 1, 1, 1, "b"), (1, 1, 0, 1, 1, "c"), (1, 2, 0, 1, 2, "d")], "t int, row int, ord int, row_span int, col_span int, text string")
    placed = tables.occupy(cells, ["t"])
    assert rows(placed, "text", "row", "col") == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 2, 0)]
    assert tables.covered(placed).count() == 6
    assert rows(tables.unmerge(placed, ["t"]), "row", "col", "text") == [(0, 0, "a"), (0, 1, "b"), (1, 0, ""), (1, 1, "c"), (2, 0, "d"), (2, 1, "")]
    flat = spark.createDataFrame([(1, 0, 0, 1, 1, "a"), (1, 0, 1, 1, 1, "b"), (1, 1, 0, 1, 1, "c")], "t int, row int, col int, row_span int, col_span int, text string")
    assert rows(tables.merge_right(flat, ["t"], F.lit(0), F.lit(0)), "row", "col_span", "text") == [(0, 2, "a\nb"), (1, 1, "c")]
    assert rows(tables.insert_row(flat, ["t"], F.lit(0)), "row", "text") == [(0, "a"), (0, "b"), (1, ""), (1, ""), (2, "c")]
    assert rows(tables.delete_row(flat, ["t"], F.lit(0)), "row", "text") == [(0, "c")]
    assert tables.new_table(spark.createDataFrame([(1, 2, 3)], "t int, rows int, cols int")).count() == 6
    heights = cells.withColumn("height", F.lit(10) * F.col("row_span"))
    assert rows(tables.row_heights(heights, ["t"]).fillna(0), "row", "height") == [(0, 10), (1, 10), (2, 10)]


def test_layout(spark):
    b = spark.createDataFrame([(1, i, h, f) for i, (h, f) in enumerate([(60.0, False), (50.0, False), (300.0, False), (10.0, True), (10.0, False)])], "doc int, ord int, height double, brk boolean")
    assert [r[1] for r in rows(layout.paginate(b, ["doc"], "ord", "height", F.lit(100.0), "brk"), "ord", "page")] == [0, 1, 2, 3, 4]
    p = spark.createDataFrame([(210.4, 296.1), (297.0, 210.0), (139.7, 180.3)], "w double, h double").select(layout.paper(F.col("w"), F.col("h")).alias("p"))
    assert [r.p for r in p.collect()] == ["a4", "a4", None]


def test_edits(spark):
    blocks = spark.createDataFrame([(1, "b1", "p", "x", 0.0, False), (1, "b2", "h1", "y", 20.0, False), (1, "b3", "p", "z", 0.0, False)], "doc_id int, data_id string, tag string, text string, indent double, numbered boolean")
    patches = spark.createDataFrame([(1, "b1", "outdent", None, 1), (1, "b1", "text", "new", 2), (1, "b2", "numbered", "outline", 3), (1, "b1", "numbered", "outline", 3), (1, "b3", "delete", None, 4)], "doc_id int, data_id string, op string, arg string, seq int")
    assert rows(edits.apply_patches(blocks, patches), "data_id", "text", "indent", "numbered") == [("b1", "new", 0.0, False), ("b2", "y", 20.0, True)]
    order = spark.createDataFrame([(1, f"b{i}", i, "b3", "b1") for i in range(4)], "doc int, data_id string, ord int, what string, before string")
    assert rows(edits.move_block(order, ["doc"], "what", "before"), "ord", "data_id") == [(0, "b0"), (1, "b3"), (2, "b1"), (3, "b2")]


def test_closure_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(150)] + [(150, 0), (7, 400)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 0), (2, 149)], "root long, node long")
    got = {(r.root, r.node) for r in ordered.closure(seeds, edges).collect()}
    every = [*range(151), 400]
    assert got == {(1, n) for n in every} | {(2, n) for n in every}


def test_ranked_over_the_whole_table(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000, str(k)) for k in range(1000)], "at long, name string").repartition(5)
    got = sorted((r.place, r.at) for r in ordered.ranked(rows, "at", "place").collect())
    assert got == [(k, k) for k in range(1000)]


def test_record_parents_of_deep_levels(spark):
    from foliant.sources import containers

    levels = [*range(15), 3, 4, 1, 14, 2, 3, 0, 1, 1000, 1001]
    rows = spark.createDataFrame([(1, "s", k, v) for k, v in enumerate(levels)], "doc_id long, stream string, seq int, level int")
    got = {r.seq: r.parent for r in containers.record_parents(rows).collect()}
    for k, v in enumerate(levels):
        assert got[k] == max((j for j in range(k) if levels[j] == v - 1), default=None), k


def test_field_codes_of_any_depth(spark):
    from foliant.operators import streams

    text = "a[b[c[d[e[f|g]h|i]j|k]l|m]n|o]p[q]rst[u|[v|w]x]"
    codes = {"[": 0x13, "|": 0x14, "]": 0x15}
    shown, stack = [], []
    for c in text:
        if c == "[":
            stack.append(True)
        elif c == "|":
            stack[-1] = False
        elif c == "]":
            stack.pop()
        elif not any(stack):
            shown.append(c)
    rows = spark.createDataFrame([(1, k, codes.get(c, ord(c))) for k, c in enumerate(text)], "doc_id long, cp int, code int")
    got = "".join(chr(r.code) for r in streams.hide_field_codes(rows, ["doc_id"]).orderBy("cp").collect())
    assert got == "".join(shown)


def test_pages_of_blocks():
    from foliant.operators import layout

    assert layout.pages_of([50, 60, 100, 300, 10, 10, 90], [0, 0, 0, 0, 1, 0, 0], 100) == [0, 1, 2, 3, 4, 5, 5]
