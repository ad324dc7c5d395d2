"""HTML tables as grids of cells with spans (standard-library parser), and measures on them.

Texts are what a table cell shows; attributes other than spans aren't kept. A span
that is not a positive whole number counts as 1. Nested tables' rows count as rows of
the outer table.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from html.parser import HTMLParser


@dataclass(eq=False, slots=True)
class Cell:
    text: str = ""
    cols: int = 1
    rows: int = 1
    tag: str = "td"

    def bare(self, nfkc: bool) -> str:
        """Without any white space, in NFKC if asked for."""
        return "".join((unicodedata.normalize("NFKC", self.text) if nfkc and not self.text.isascii() else self.text).split())


#: Spans beyond these count as these, as in HTML itself; they come from untrusted pages.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


@dataclass
class Grid:
    rows: list[list[Cell]] = field(default_factory=list)
    tabled: bool = False

    def plain(self) -> bool:
        """Has no cell a span? Then a row's cells are its columns, and nothing has to be placed."""
        for cells in self.rows:
            for c in cells:
                if c.cols != 1 or c.rows != 1:
                    return False
        return True

    def placed(self) -> list[dict[int, tuple[Cell, int]]]:
        """For each row, the cell and its own row at every column; built once for rows that stay as they are."""
        key = [[(id(c), c.cols, c.rows) for c in r] for r in self.rows]
        if getattr(self, "_key", None) != key:
            self._key, self._placed = key, self._place()
        return self._placed

    def _place(self) -> list[dict[int, tuple[Cell, int]]]:
        at: list[dict[int, tuple[Cell, int]]] = [{} for _ in self.rows]
        for r, cells in enumerate(self.rows):
            col = 0
            for cell in cells:
                while col in at[r]:
                    col += 1
                for rr in range(r, r + cell.rows):
                    if rr < len(at):
                        at[rr].update((c, (cell, r)) for c in range(col, col + cell.cols))
                col += cell.cols
        return at

    def total_columns(self) -> int:
        """Right end of the cells where they begin."""
        if self.plain():
            return max(map(len, self.rows), default=0)
        best = 0
        for r, here in enumerate(self.placed()):
            best = max([best, *(c + 1 for c, (_, own) in here.items() if own == r)])
        return best

    def effective_columns(self) -> list[int]:
        if self.plain():
            return [len(cells) for cells in self.rows]
        return [max(here, default=-1) + 1 for here in self.placed()]

    def row_cells(self, r: int) -> list[tuple[Cell, int]]:
        """Distinct cells that cover a row, from left to right, with the rows they begin in."""
        if self.plain():
            return [(c, r) for c in self.rows[r]]
        seen: dict[int, tuple[Cell, int]] = {}
        here = self.placed()[r]
        for c in sorted(here):
            seen.setdefault(id(here[c][0]), here[c])
        return list(seen.values())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.grid, self.cell = Grid(), None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.grid.tabled = True
        elif tag == "tr":
            self.cell = None
            self.grid.rows.append([])
        elif tag in ("td", "th") and self.grid.rows:
            spans = dict(attrs)
            n = [int(v) if (v := (spans.get(k) or "1").strip()).isascii() and v.isdigit() and int(v) else 1 for k in ("colspan", "rowspan")]
            self.cell = Cell("", min(n[0], MOST_COLUMNS), min(n[1], MOST_ROWS), tag)
            self.grid.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.text += data


#: A table as ``to_html`` writes it, without spans and character references: read without the parser, to the same grid.
_SIMPLE = re.compile(r"<table>(?:<tr>(?:<t[hd]>[^<>&]*+</t[hd]>)*+</tr>)*+</table>")
_CELLS = re.compile(r"<(t[hd])>([^<]*)")


def parse(source: str | None) -> Grid:
    if source and _SIMPLE.fullmatch(source):
        return Grid([[Cell(shown, 1, 1, tag) for tag, shown in _CELLS.findall(row)] for row in source.split("<tr>")[1:]], True)
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    return reader.grid


def to_html(grid: Grid) -> str:
    """Canonical form: one table, no white space between tags."""
    def cell(c: Cell) -> str:
        spans = (f' rowspan="{c.rows}"' if c.rows > 1 else "") + (f' colspan="{c.cols}"' if c.cols > 1 else "")
        return f"<{c.tag}{spans}>{html.escape(c.text, quote=False)}</{c.tag}>"

    return "<table>" + "".join("<tr>" + "".join(map(cell, row)) + "</tr>" for row in grid.rows) + "</table>"


def header_rows(a: Grid, b: Grid, most: int = 5, nfkc: bool = True) -> int:
    """Leading rows that are equal in spans and texts."""
    shape = lambda row: [(c.cols, c.rows, c.bare(nfkc)) for c in row]
    n = 0
    for x, y in list(zip(a.rows, b.rows, strict=False))[:most]:
        if shape(x) != shape(y):
            break
        n += 1
    return n


def header_rows_visual(a: Grid, b: Grid, most: int = 5) -> int:
    """Leading rows that are equal in texts and effective columns."""
    ea, eb = a.effective_columns(), b.effective_columns()
    n = 0
    for k, (x, y) in enumerate(list(zip(a.rows, b.rows, strict=False))[:most]):
        if [c.bare(True) for c in x] != [c.bare(True) for c in y] or ea[k] != eb[k]:
            break
        n += 1
    return n


def _described(grid: Grid, rows: range, nfkc: bool) -> list[list[str]]:
    """Cells of rows with their spans, row by row until one that isn't a single full-width cell."""
    total, out = grid.total_columns(), []
    for r in rows:
        cells = [c for c, _ in grid.row_cells(r)]
        if not cells:
            continue
        line = []
        for c in cells:
            spans = [f"{k}={v}" for k, v in (("rowspan", c.rows), ("colspan", c.cols)) if v > 1]
            shown = "".join(p.strip() for p in c.text.split("\n"))
            shown = unicodedata.normalize("NFKC", shown) if nfkc and not shown.isascii() else shown
            line.append(f"{','.join(spans)}, {shown}" if spans else shown)
        out.append(line)
        if not (len(cells) == 1 and cells[0].cols >= total):
            break
    return out


def last_rows(grid: Grid, most: int = 5) -> list[list[str]]:
    n = len(grid.rows)
    return _described(grid, range(n - 1, max(-1, n - 1 - most), -1), False)[::-1]


def first_data_rows(grid: Grid, headers: int, most: int = 5) -> list[list[str]]:
    n = len(grid.rows)
    start = min(headers, n - 1)
    return _described(grid, range(start, min(start + most, n)), True) if n else []


def rows_match(a: Grid, b: Grid) -> bool:
    """Do the last row of one table and the first data row of the next agree in columns, by any of three counts?"""
    upper = next((r for r in range(len(a.rows) - 1, -1, -1) if a.rows[r]), None)
    lower = header_rows(a, b)
    if upper is None or lower >= len(b.rows):
        return False
    span = lambda row: sum(c.cols for c in row)
    return a.effective_columns()[upper] == b.effective_columns()[lower] or span(a.rows[upper]) == span(b.rows[lower]) or len(a.rows[upper]) == len(b.rows[lower])


def _widen(rows: list[list[Cell]], model: list[Cell], spans: list[int], missing: int, target: int) -> None:
    """Bring narrow rows to the target width: like the model row if they have its shape, else by their last cell."""
    shape = [c.cols for c in model]
    for row in rows:
        if not row or sum(c.cols for c in row) >= target:
            continue
        if len(row) == len(spans) and [c.cols for c in row] == shape:
            for c, n in zip(row, spans, strict=True):
                c.cols = n if n > 1 else c.cols
        else:
            row[-1].cols += missing


def _join_cells(above: list[tuple[Cell, int]], below: list[Cell], flags: list, last: int) -> bool:
    """Move flagged cells' texts into the cells above; true if nothing is left below."""
    gone = []
    for (up, own), down, flag in zip(above, list(below), flags, strict=False):
        if flag != 1:
            continue
        up.text = up.text.strip() + down.text.strip()
        if own < last:
            up.rows += down.rows
            gone.append(down)
        elif down.rows > 1:
            up.rows = down.rows
            gone.append(down)
        else:
            down.text = ""
    below[:] = [c for c in below if not any(c is g for g in gone)]
    return not any(c.text.strip() for c in below)


def merge(upper: str, lower: str, flags: list | None) -> str:
    """The rows of the lower table under those of the upper one, without the repeated header."""
    a, b = parse(upper), parse(lower)
    if not a.rows or not b.rows or not a.tabled or not b.tabled:
        return upper
    head = header_rows(a, b, nfkc=False)
    skip = 0
    if head < len(b.rows):
        above = a.row_cells(len(a.rows) - 1)
        wide, narrow = a.total_columns(), b.total_columns()
        first, last = b.rows[head], a.rows[-1]
        if wide >= narrow:
            _widen(b.rows[head:], [Cell(cols=c.cols) for c in first], [c.cols for c in last], wide - narrow, wide)
        else:
            _widen(a.rows, [Cell(cols=c.cols) for c in last], [c.cols for c in first], narrow - wide, narrow)
        if flags is not None:
            skip = int(_join_cells(above, first, flags, len(a.rows) - 1))
    a.rows += b.rows[head + skip :]
    return to_html(a)
