"""Overlapping duplicates of letters: the same character drawn again within a third of its mean character width.

A sequential rule over the letters of a page, so pages are filtered in place in Arrow calls: one shuffle, or none, no join back. Of many
pages at a time, letters that are near no other, or one other alone, are told by array steps; the rule is walked through for the rest. (A fold
in SQL functions copies the slots at every letter and was slower by two orders of magnitude.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .together import Packed, by_pages, by_seq


def crowded(values: list[str], x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Which letters have another of their value within the cells of size `reach` around their own; only these can be duplicates."""
    n = len(values)
    code = np.unique(np.array(values, object).astype(str), return_inverse=True)[1]
    cx, cy = (np.floor((c - c.min()) / reach) + 1 for c in (x, y))
    wide, high = cx.max() + 2, cy.max() + 2
    if not reach > 0 or wide * high * (code.max() + 1) > 2**62:
        return np.ones(n, bool)
    cell = (code * int(wide) + cx.astype(np.int64)) * int(high) + cy.astype(np.int64)
    cells, count = np.unique(cell, return_counts=True)
    near = np.zeros(n, np.int64)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            other = cell + dx * int(high) + dy
            at = np.minimum(np.searchsorted(cells, other), len(cells) - 1)
            near += np.where(cells[at] == other, count[at], 0)
    return near > 1


def kept(values: list[str], x: np.ndarray, y: np.ndarray, width: np.ndarray, keep_last: bool = True) -> np.ndarray:
    """Which letters stay. Each letter looks through the standing representatives of its value in slot order for the first whose
    corner is within its own tolerance, border included, on both axes. keep_last: it takes over that slot; else it is dropped."""
    out = np.ones(len(values), bool)
    if not len(values):
        return out
    tolerance = np.asarray(width, float) / np.array([max(len(v), 1) for v in values]) / 3
    # cells a little wider than any tolerance: what is near enough is in the cell or around it
    reach = float(tolerance.max()) * (1 + 1e-9)
    wide = reach if reach > 0 else 1.0
    cells: dict[tuple, list[int]] = {}
    cx, cy = (np.floor(np.asarray(c, float) / wide).tolist() for c in (x, y))
    tolerance, x, y = tolerance.tolist(), np.asarray(x, float).tolist(), np.asarray(y, float).tolist()
    held: list[int] = []  # the letter of each slot
    for i in np.flatnonzero(crowded(values, np.array(x), np.array(y), reach)).tolist():
        v, tol, a, b, found = values[i], tolerance[i], cx[i], cy[i], -1
        for p in (a - 1, a, a + 1):
            for q in (b - 1, b, b + 1):
                for k in cells.get((v, p, q), ()):
                    if (found < 0 or k < found) and abs(x[held[k]] - x[i]) <= tol and abs(y[held[k]] - y[i]) <= tol:
                        found = k
        if found < 0:
            found = len(held)
            held.append(i)
        elif keep_last:
            before = held[found]
            out[before] = False
            held[found] = i
            if (cx[before], cy[before]) == (a, b):
                continue
            cells[v, cx[before], cy[before]].remove(found)
        else:
            out[i] = False
            continue
        cells.setdefault((v, a, b), []).append(found)
    return out


def lone_pairs(group: np.ndarray, x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of one group (of a page, with one value) within reach (one for a group) of each other on both axes, by cells of that size: pairs (i < j) that are
    near no third letter, and whether a letter belongs to more. Letters of places that can't be put into cells belong to more."""
    n, none = len(group), np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(0, bool)
    if not all(np.isfinite(c).all() for c in (reach, x, y)):
        return none, none, np.ones(n, bool)
    cx, cy = (np.floor((c - c.min()) / reach) for c in (x, y))  # least of all groups: cells are told by groups
    wide, high = cx.max() + 3, cy.max() + 3
    if wide * high * (float(group.max()) + 1) > 2**62:
        return none, none, np.ones(n, bool)
    key = (group * int(high) + cy.astype(np.int64) + 1) * int(wide) + cx.astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    # of pairs, one is found from each end or in the same cell: what comes later in this order, in the row of cells, and in the next row
    place = np.arange(n)
    here = np.searchsorted(key, key + 1, "right") - place - 1
    below = np.searchsorted(key, key + int(wide) - 1)
    under = np.searchsorted(key, key + int(wide) + 1, "right") - below
    many = np.column_stack((here, under)).ravel()
    start = np.column_stack((place + 1, below)).ravel()
    more = np.zeros(n, bool)
    # where many stand together, letters aren't paired at all
    crowd = np.repeat(here + under > 16, 2)
    for k in np.flatnonzero(crowd[::2]).tolist():
        more[order[k]] = True
        more[order[place[k] + 1 : place[k] + 1 + here[k]]] = True
        more[order[below[k] : below[k] + under[k]]] = True
    many = np.where(crowd, 0, many)
    a = np.repeat(np.repeat(place, 2), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
    a, b = order[a], order[b]
    near = (np.abs(x[a] - x[b]) <= reach[a]) & (np.abs(y[a] - y[b]) <= reach[a])
    a, b = a[near], b[near]
    count = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    more |= count > 1
    # what is near one that is near more is judged with it
    while (spread := more[a] ^ more[b]).any():
        more[a[spread]] = more[b[spread]] = True
    alone = ~more[a]
    a, b = a[alone], b[alone]
    return np.minimum(a, b), np.maximum(a, b), more


def kept_of_pages(page: np.ndarray, value: pa.Array, x: np.ndarray, y: np.ndarray, width: np.ndarray, keep_last: bool = True) -> np.ndarray:
    """kept() of the letters of many pages, by rising page."""
    x, y, width = (np.asarray(c, float) for c in (x, y, width))
    words = value.dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    n_chars = np.maximum(np.array([len(v) for v in words.dictionary.to_pylist()], np.int64), 1)
    tolerance = width / n_chars[code] / 3 if len(code) else width
    out = np.ones(len(code), bool)
    if not len(code):
        return out
    begin = np.flatnonzero(np.diff(page, prepend=page[0] - 1))
    reach = np.maximum.reduceat(tolerance, begin) * (1 + 1e-9)
    reach = np.repeat(np.where(reach > 0, reach, 1.0), np.diff(np.append(begin, len(page))))
    i, j, more = lone_pairs(page * len(n_chars) + code, x, y, reach)
    same = (np.abs(x[i] - x[j]) <= tolerance[j]) & (np.abs(y[i] - y[j]) <= tolerance[j])
    out[(i if keep_last else j)[same]] = False
    rest = np.flatnonzero(more)
    for own in np.split(rest, np.flatnonzero(np.diff(page[rest])) + 1) if len(rest) else ():
        out[own] = kept(value.take(pa.array(own)).to_pylist(), x[own], y[own], width[own], keep_last)
    return out


def dedup(letters: DataFrame | Packed, keep_last: bool = True, keys: tuple[str, ...] = ("doc_id", "page_no"), together: bool = False) -> DataFrame | Packed:
    """letters (keys, seq, value, x, y, width, ...) of each page without duplicates; letters without a value or place stay as they are.

    together: see `together.by_page`; packed letters stay packed."""

    def run(t: pa.Table, at: np.ndarray) -> pa.Table:
        t, page = by_seq(t, at)
        whole = np.logical_and.reduce([t[k].is_valid().to_numpy() for k in ("value", "x", "y", "width")])
        stay = np.ones(len(t), bool)
        own = t.select(["value", "x", "y", "width"]).filter(pa.array(whole)).combine_chunks()
        if len(own):
            stay[whole] = kept_of_pages(page[whole], own["value"].chunk(0), *(own[k].to_numpy() for k in ("x", "y", "width")), keep_last)
        return t.filter(pa.array(stay))

    return by_pages(letters, keys, run, letters.schema, together)
