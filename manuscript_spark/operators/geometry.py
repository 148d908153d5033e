"""Tables from positioned text runs of a page. Experimental, as prose in columns can look like a table."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tolerances in line heights; confidences.
ROW, COLUMN, GAP, SPACE, LINE = 0.5, 0.5, 2.5, 0.2, 10.0
REPORT, ACCEPT = 0.35, 0.75
TABLE = "doc_id long, page int, rows array<array<string>>, top double, bottom double, confidence double"


def unit(v: float) -> float:
    return float(min(1.0, max(0.0, v)))


def line_height(heights: np.ndarray, ys: np.ndarray) -> float:
    """The median run height; else the median distance of baselines, less leading; else a default."""
    h = heights[np.isfinite(heights) & (heights > 0)]
    if len(h):
        return float(np.median(h))
    gaps = np.diff(np.unique(ys))
    return float(np.median(gaps)) / 1.2 if len(gaps) else LINE


def line_up(p: pd.DataFrame, tolerance: float) -> list[pd.DataFrame]:
    """Rows of runs from the top: a new one where the baseline drops by more than the tolerance since the run before."""
    p = p.sort_values("y", ascending=False, kind="stable")
    island = (p["y"].diff().abs() > tolerance).cumsum()
    return [g.sort_values("x", kind="stable") for _, g in p.groupby(island, sort=True)]


def edges(rows: list[pd.DataFrame], which: range, tolerance: float) -> np.ndarray:
    """Left edges that at least two rows share: single links along x, no cluster wider than two tolerances."""
    x = np.concatenate([rows[i]["x"].to_numpy() for i in which])
    of = np.concatenate([np.full(len(rows[i]), i) for i in which])
    order = np.argsort(x, kind="stable")
    groups: list[list[int]] = []
    for k in order:
        if groups and x[k] - x[groups[-1][-1]] <= tolerance and x[k] - x[groups[-1][0]] <= 2 * tolerance:
            groups[-1].append(k)
        else:
            groups.append([k])
    return np.array([x[g].mean() for g in groups if len(set(of[g])) >= 2])


def touched(row: pd.DataFrame, at: np.ndarray, tolerance: float) -> frozenset:
    near = np.abs(row["x"].to_numpy()[:, None] - at[None, :]) <= tolerance
    return frozenset(near.argmax(1)[near.any(1)].tolist())


def regions(rows: list[pd.DataFrame], ys: list[float], height: float) -> list[tuple[range, np.ndarray]]:
    """Runs of rows, close together, that all share at least two edges."""
    tolerance = height * COLUMN
    at = edges(rows, range(len(rows)), tolerance)
    if len(at) < 2:
        return []
    hits, out, first = [touched(r, at, tolerance) for r in rows], [], 0
    while first < len(rows):
        last, shared = first, hits[first]
        while last + 1 < len(rows) and abs(ys[last] - ys[last + 1]) <= height * GAP and len(shared & hits[last + 1]) >= 2:
            last, shared = last + 1, shared & hits[last + 1]
        if last > first and len(shared) >= 2:
            own = edges(rows, range(first, last + 1), tolerance)
            if len(own) >= 2:
                out.append((range(first, last + 1), own))
        first = last + 1 if last > first else first + 1
    return out


def cell_text(cell: list[tuple], height: float) -> str:
    text, right = "", None
    for s, x, width in cell:
        if s.strip() or not text:
            text += (" " if text and right is not None and x - right > height * SPACE else "") + s
        right = x + width
    return re.sub(r"\s+", " ", text).strip()


def table(rows: list[pd.DataFrame], which: range, at: np.ndarray, height: float, stranded: int) -> tuple[list[list[str]], float]:
    """The grid of a region and how sure it is one."""
    tolerance, cells = height * COLUMN, []
    runs = aligned = straddling = 0
    for i in which:
        line: list[list[tuple]] = [[] for _ in at]
        for s, x, width in zip(rows[i]["str"], rows[i]["x"], rows[i]["width"]):
            apart = np.abs(at - x)
            nearest = int(apart.argmin())
            fits = apart[nearest] <= tolerance
            c = nearest if fits else int(max(np.flatnonzero(at <= x), default=0))
            follows = bool(line[c]) and x - (line[c][-1][1] + line[c][-1][2]) <= height
            runs, aligned = runs + 1, aligned + bool(fits or follows)
            straddling += bool((x + width > at[c + 1 :] + tolerance).any())
            line[c].append((s, x, width))
        cells.append(line)
    grid = [[cell_text(c, height) for c in line] for line in cells]
    counts = [sum(c != "" for c in line) for line in grid]
    modal = max(Counter(counts).items(), key=lambda x: (x[1], x[0]))[0]
    texts = [c for line in grid for c in line if c]
    filled = len(texts) / (len(grid) * len(at))
    extent = [max([x + w - a for line in cells for _, x, w in line[k]], default=0.0) for k, a in enumerate(at)]
    fills = [unit((line[k][-1][1] + line[k][-1][2] - line[k][0][1]) / extent[k]) for k in range(len(at)) if extent[k] > 0 for line in cells if line[k]]
    wordy = unit((np.mean([len(t.split()) for t in texts]) - 3) / 5) if texts else 0.0
    full = unit((np.mean(fits_) - 0.65) / 0.25) if (fits_ := fills) else 0.0
    score = 0.4 * counts.count(modal) / len(counts) + 0.6 * filled
    score *= (1 - unit(2 * (runs - aligned) / runs)) * (1 - unit(2 * straddling / runs))
    return grid, unit(score * (1.0 if len(grid) >= 3 else 0.8) * (1 - 0.25 * stranded) * (1 - 0.9 * wordy * full))


def page_tables(p: pd.DataFrame) -> list[tuple[list[list[str]], float, float, float]]:
    """(grid, top, bottom, confidence) of the tables of a page (str, x, y, width, height), surest first."""
    p = p[np.isfinite(p["x"]) & np.isfinite(p["y"]) & (p["str"].fillna("").str.strip() != "")]
    if len(p) < 4:
        return []
    height = line_height(p["height"].to_numpy(float), p["y"].to_numpy())
    rows = line_up(p, height * ROW)
    ys = [float(np.median(r["y"])) for r in rows]
    out = []
    for which, at in regions(rows, ys, height):
        beside = 0
        for n, edge in ((which[0] - 1, which[0]), (which[-1] + 1, which[-1])):
            if 0 <= n < len(rows) and len(rows[n]) >= 2 and abs(ys[n] - ys[edge]) <= height * GAP:
                beside += bool((np.abs(rows[n]["x"].to_numpy()[:, None] - at[None, :]) <= height * COLUMN).any())
        grid, sure = table(rows, which, at, height, beside)
        if sure >= REPORT:
            own = [ys[i] for i in which]
            out.append((grid, max(own), min(own), sure))
    return sorted(out, key=lambda t: -t[3])


def find_tables(items: DataFrame) -> DataFrame:
    """Tables of pages; items: doc_id, page, str, x, y, width, height (null: unknown). A group is one page."""

    def page(p: pd.DataFrame) -> pd.DataFrame:
        p = p.copy()
        p["height"] = p["height"].astype(float)
        found = page_tables(p)
        return pd.DataFrame([(p["doc_id"].iloc[0], p["page"].iloc[0], *t) for t in found], columns=["doc_id", "page", "rows", "top", "bottom", "confidence"])

    return items.groupBy("doc_id", "page").applyInPandas(page, TABLE)


def accepted_tables(items: DataFrame) -> DataFrame:
    return find_tables(items).where(F.col("confidence") >= ACCEPT)
