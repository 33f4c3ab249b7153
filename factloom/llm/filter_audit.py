"""Filter interaction audit by count-weighted decision diagrams.

What fails which filters is a mask of bits. Spark counts the masks of each part (documents, good and toxic ones), so a part
of any size becomes at most 2^filters counts. From these a zero-suppressed decision diagram is built: a level a filter, a
node's two children are what passes it and what fails it, equal nodes are one, nodes that nothing fails are left out, and
each node carries the counts below it. Swaps of adjacent levels, in place, take it through all orders; along the
all-pass path of each order stand what each step removes and what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import as_batch, settle

Counts = tuple[int, int, int]
NOTHING: Counts = (0, 0, 0)
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _sum(a: Counts, b: Counts) -> Counts:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class Diagram:
    """The counts of failure masks as a diagram; `order` lists the filters' numbers, the first applied first."""

    EMPTY = 0
    _LEAF = -1

    def __init__(self, counts: Mapping[int, Counts], filters: int):
        self.order = list(range(filters))
        self.variable, self.passed, self.failed, self.weight = [self._LEAF], [0], [0], [NOTHING]
        self._known: dict[tuple, int] = {}
        self.root = self._built({m: c for m, c in counts.items() if c != NOTHING}, 0)

    def _new(self, key: tuple, variable: int, passed: int, failed: int, weight: Counts) -> int:
        if key not in self._known:
            self._known[key] = len(self.variable)
            for column, value in ((self.variable, variable), (self.passed, passed), (self.failed, failed), (self.weight, weight)):
                column.append(value)
        return self._known[key]

    def _node(self, variable: int, passed: int, failed: int) -> int:
        if failed == self.EMPTY:
            return passed
        return self._new((variable, passed, failed), variable, passed, failed, _sum(self.weight[passed], self.weight[failed]))

    def _built(self, counts: dict[int, Counts], level: int) -> int:
        if not counts:
            return self.EMPTY
        if level == len(self.order):
            weight = next(iter(counts.values()))
            return self._new((self._LEAF, weight), self._LEAF, 0, 0, weight)
        bit = 1 << self.order[level]
        passed = self._built({m: c for m, c in counts.items() if not m & bit}, level + 1)
        return self._node(self.order[level], passed, self._built({m: c for m, c in counts.items() if m & bit}, level + 1))

    def nodes(self) -> set[int]:
        """Those that the root reaches, leaves too."""
        found, open_ = set(), [self.root]
        while open_:
            node = open_.pop()
            if node not in found:
                found.add(node)
                if self.variable[node] != self._LEAF:
                    open_ += (self.passed[node], self.failed[node])
        return found

    def swap(self, level: int) -> None:
        """Exchange the filters of two adjacent levels. Nodes of the upper one are changed in place, so nothing above them is touched."""
        x, y = self.order[level], self.order[level + 1]
        alive = self.nodes()
        self._known = {k: n for k, n in self._known.items() if n in alive}
        for node in sorted(n for n in alive if self.variable[n] == x):
            children = self.passed[node], self.failed[node]
            if all(self.variable[c] != y for c in children):
                continue
            # of each child what passes y and what fails it; a child without y passes as a whole
            (pp, pf), (fp, ff) = ((self.passed[c], self.failed[c]) if self.variable[c] == y else (c, self.EMPTY) for c in children)
            del self._known[x, *children]
            self.passed[node], self.failed[node] = self._node(x, pp, fp), self._node(x, pf, ff)
            self.variable[node] = y
            self._known[y, self.passed[node], self.failed[node]] = node
        self.order[level], self.order[level + 1] = y, x

    def all_pass(self) -> Iterator[tuple[int, Counts, Counts]]:
        """Of each step, in order: its filter, what it removes, what is kept after it."""
        node = self.root
        for f in self.order:
            removed = NOTHING
            if self.variable[node] == f:
                removed, node = self.weight[self.failed[node]], self.passed[node]
            yield f, removed, self.weight[node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next one, one after the other, so that all n! orders are met (plain changes)."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        try:
            yield next(inner) + (1 if down else 0)  # the last filter is at the front after going down
        except StopIteration:
            return
        down = not down


def audit_of(counts: Mapping[int, Counts], letters: str) -> Iterator[tuple]:
    """filter_order, step and COLUMNS for every order of the letters and each of its steps."""
    n = len(letters)
    fails = [sum(c[0] for m, c in counts.items() if m >> f & 1) for f in range(n)]
    alone = [counts.get(1 << f, NOTHING)[0] for f in range(n)]
    diagram, shapley, rows = Diagram(counts, n), [0] * n, []

    def walk():
        name = "".join(letters[f] for f in diagram.order)
        for step, (f, removed, kept) in enumerate(diagram.all_pass(), 1):
            shapley[f] += removed[0]
            rows.append((name, step, f, kept[0], removed))

    walk()
    for level in adjacent_swaps(n):
        diagram.swap(level)
        walk()
    for name, step, f, kept, removed in rows:
        yield name, step, kept, removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shapley[f]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Conditions under which a document fails, over its text and its words.
CONDITIONS = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}


def failure_counts(docs: DataFrame, labels: DataFrame, conditions: Mapping = CONDITIONS, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good and toxic: documents by part and by what they fail. Bit i is the i-th condition, the bit after the last that of copies."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    own = own.withColumn("words", _words(F.col("text")))
    mask = F.lit(0)
    for i, fails in enumerate(conditions.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(F.lit(0))
    masks = settle(own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    # each text's first document; what is none of these is a copy. Both joins are on ids, so copies of one text meet in no task
    first = masks.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = masks.join(marked.hint("merge"), "id", "left").join(first.hint("merge"), ["id", "digest"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return known.groupBy("part", (F.col("mask") + F.when(copy, F.lit(1 << len(conditions))).otherwise(F.lit(0))).alias("mask")).agg(F.count("*").alias("n"), total("good"), total("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, conditions: Mapping = CONDITIONS, *, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    conditions: a letter each, with a function of text and words (columns) that says when a document fails; `copies` is the
    letter of the last filter, which fails a text that a smaller id has too, in any part. Null texts count as empty, null
    parts as ''. A row without an id is no copy, makes none, and has no label; rows that repeat with their id count each
    and are no copies of one another; of several labels of an id one with 1 decides. An empty table gives no rows;
    further columns are not read. All orders are listed, so filters should be few: 8 give 40,320 a part.
    """
    letters = "".join(conditions) + copies
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COLUMNS]])

    def audit(batches):
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(audit_of({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts}, letters))
                yield as_batch([[part] * len(rows), *zip(*rows, strict=True)], schema)

    counts = failure_counts(docs, labels, conditions, id_col=id_col, text_col=text_col, part_col=part_col)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a part's rows are few but all orders of it cost some milliseconds, so tasks are not merged by size
    by_part = counts.repartition(tasks, "part").groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 2^filters of them
    return by_part.mapInArrow(audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))
