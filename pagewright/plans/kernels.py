"""Passes over rows sorted by document, for folds that no window can say in linear time.

Each kernel takes rows that are partitioned by ``doc_id`` and sorted within it, and streams over
Arrow batches: many short documents at once, or one long document in bounded state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows of a batch that a kernel passes on.
BATCH = 8192


def by_document(rows: DataFrame, order: list, fields: str, kernel: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``kernel`` over all rows of a partition as tuples, documents one after another; gives doc_id and ``fields``."""
    group = rows.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", group), *StructType.fromDDL(fields).fields])
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", *order)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []
        for row in kernel(tuples()):
            out.append(row)
            if len(out) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def _nearest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One stack of rows with rising values; a row leaves it, and is passed on, when one as small comes."""
    stack: list[tuple] = []
    doc, begun = None, False
    for d, k, value in rows:
        if not begun or d != doc:
            yield from ((doc, k0, parent, depth, None) for _, k0, parent, depth in reversed(stack))
            stack, doc, begun = [], d, True
        while stack and stack[-1][0] >= value:
            _, k0, parent, depth = stack.pop()
            yield doc, k0, parent, depth, k
        stack.append((value, k, stack[-1][1] if stack else None, len(stack) + 1))
    yield from ((doc, k0, parent, depth, None) for _, k0, parent, depth in reversed(stack))


def nearest_smaller(rows: DataFrame) -> DataFrame:
    """(doc_id, k, parent, depth, stop) of rows (doc_id, k, value): the nearest earlier row with a smaller value, how many
    such steps lead up (itself included), and the next row with a value as small or smaller.

    One pass; the state is a stack with as many rows as there are different values at most.
    """
    return by_document(rows.selectExpr("doc_id", "cast(k as bigint) k", "cast(value as int) value"), ["k"], "k bigint, parent bigint, depth int, stop bigint", _nearest)


def _forest(rows: Iterator[tuple]) -> Iterator[tuple]:
    def told(doc, nodes: list[tuple]) -> Iterator[tuple]:
        children: dict = {}
        for node, parent, *top in nodes:
            children.setdefault(parent, []).append((node, top))
        rank = 0
        todo = [(node, top, 0) for node, top in reversed(children.get(None, [])) if top[0] is not None]
        while todo:
            node, top, depth = todo.pop()
            yield doc, node, *top, rank, depth
            rank += 1
            todo += [(child, top, depth + 1) for child, _ in reversed(children.get(node, []))]

    doc, held = None, []
    for d, _, *node in rows:
        if held and d != doc:
            yield from told(doc, held)
            held = []
        doc = d
        held.append(node)
    if held:
        yield from told(doc, held)


def forest(rows: DataFrame) -> DataFrame:
    """(doc_id, id, stop, text_depth, rank, depth) of rows (doc_id, ord, id, parent, stop, text_depth): preorder of the trees whose tops have no parent.

    A top's stop and text_depth (not null) are handed down to all below it. Nodes that hang on no such top, those in a
    circle included, are left out. Holds a few numbers for each node of one document.
    """
    rows = rows.selectExpr("doc_id", "cast(ord as bigint) ord", "cast(id as bigint) id", "cast(parent as bigint) parent", "cast(stop as bigint) stop", "cast(text_depth as int) text_depth")
    return by_document(rows, ["ord", "id"], "id bigint, stop bigint, text_depth int, rank bigint, depth int", _forest)


def _followed(rows: Iterator[tuple]) -> Iterator[tuple]:
    doc, wanted, begun = None, None, False
    for d, page, following, first in rows:
        if not begun or d != doc:
            doc, wanted, begun = d, None, True
        if first or (wanted is not None and page == wanted):
            yield d, page
            wanted = following
            if wanted is not None and wanted <= page:
                wanted = None


def followed(steps: DataFrame) -> DataFrame:
    """(doc_id, page) reached by pointers that lead forward, from rows (doc_id, page, next, first) with one start a document.

    One pass in the order of pages: each row is either the one the last pointer names or passed over. A page is reached
    only if it has a row.
    """
    return by_document(steps.selectExpr("doc_id", "cast(page as int) page", "cast(next as int) next", "first"), ["page"], "page int", _followed)


def greedy(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pairs (doc, score, a, b), best first, whose sides are both free yet; holds the sides taken in one document."""
    doc, begun, left, right = None, False, set(), set()
    for d, score, a, b in rows:
        if not begun or d != doc:
            doc, begun, left, right = d, True, set(), set()
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            yield d, a, b, score
