"""Loose JSON of models as tables: analysis items, regions of pages, whole layouts.

What models write differs from call to call: fenced text, aliases of names, boxes as lists or fields, scores
in percent. Each text is read by plain functions, row by row in Arrow batches; what can't be used is
left out and, for layouts, told in `warnings`.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.functions.checks import VISUAL_TYPES

REGION = "id string, kind string, label string, x double, y double, width double, height double, score double, confidence string"
_TYPES = {alias: k for k, names in VISUAL_TYPES.items() for alias in names}


def model_json(text: str | None):
    """The JSON of a text, or of the part from its first to its last brace; an empty object if there is none."""
    for part in (text or "", m.group(0) if (m := re.search(r"\{.*\}", text or "", re.S)) else ""):
        try:
            return json.loads(part)
        except (ValueError, RecursionError):
            continue
    return {}


def items_of(text: str | None) -> list[dict]:
    """Items of an answer: a list, the list under items, paragraphs or results, or objects keyed by paragraph."""
    got = model_json(text)
    if isinstance(got, dict):
        for k in ("items", "paragraphs", "results"):
            if isinstance(got.get(k), list):
                got = got[k]
                break
        else:
            return [{"paragraphId": k, **v} for k, v in got.items() if isinstance(v, dict)]
    return [v for v in got if isinstance(v, dict)] if isinstance(got, list) else []


def first_of(item: dict, *names: str):
    """The first of the named fields that isn't null or empty."""
    return next((item[n] for n in names if item.get(n) not in (None, "")), None)


def number(value) -> float | None:
    try:
        v = float(value)
    except (TypeError, ValueError):
        return None
    return v if math.isfinite(v) else None


def score_of(item: dict) -> float | None:
    """From 0 to 1; up to 100 it is in percent."""
    v = number(first_of(item, "score", "confidence", "probability"))
    return None if v is None else v / 100 if 1 < v <= 100 else min(1.0, max(0.0, v))


def box_of(item: dict, width: float, height: float) -> tuple[float, float, float, float] | None:
    """x, y, width, height on the page by a list or by fields; None without a positive extent on the page."""
    raw = item.get("bbox") if isinstance(item.get("bbox"), list) else item.get("box") if isinstance(item.get("box"), list) else None
    if raw is not None:
        v = [number(n) for n in raw[:4]]
    else:
        v = [number(first_of(item, *n)) for n in (("x", "left"), ("y", "top"), ("width", "w"), ("height", "h"))]
    if len(v) < 4 or any(n is None for n in v) or v[2] <= 0 or v[3] <= 0:
        return None
    x, y = min(max(v[0], 0.0), width), min(max(v[1], 0.0), height)
    w, h = min(v[0] + v[2], width) - x, min(v[1] + v[3], height) - y
    return (x, y, w, h) if w > 0 and h > 0 else None


def region_of(item: dict, page: int, width: float, height: float, nth: int) -> dict | None:
    """A region of a page, if its type is known and its box lies on the page; a score under 0.45 is of low confidence."""
    kind = _TYPES.get(str(first_of(item, "visualType", "type", "labelType") or "").strip().lower(), "")
    box = box_of(item, width, height)
    if not kind or box is None:
        return None
    score = score_of(item)
    name = re.sub(r"[^a-z0-9_-]+", "_", str(first_of(item, "id", "label") or f"{kind}_{nth}").lower()).strip("_") or f"{kind}_{nth}"
    found = {"id": f"model_{page}_{name}_{nth}", "kind": kind, "label": str(first_of(item, "label", "name") or "").strip(), "score": score, "confidence": "low" if score is not None and score < 0.45 else "high"}
    return found | dict(zip(("x", "y", "width", "height"), box, strict=True))


def layout_of(text: str | None) -> dict:
    """A layout document: pages, sections, regions, paragraphs and warnings about what was left out."""
    payload = model_json(text)
    payload = payload if isinstance(payload, dict) else {}
    source = payload["layout"] if isinstance(payload.get("layout"), dict) else payload
    warnings: list[str] = []
    listed = lambda v: [i for i in v if isinstance(i, dict)] if isinstance(v, list) else []
    under = lambda k, inner: listed(source.get(k)) or listed((source.get(inner) or {}).get(k) if isinstance(source.get(inner), dict) else None)
    pages: dict[int, dict] = {}
    for i, p in enumerate(under("pages", "document") + listed(source.get("pageSpecs"))):
        n, w, h = number(first_of(p, "pageNumber", "page", "number")) or i + 1, number(first_of(p, "width", "w")), number(first_of(p, "height", "h"))
        if not w or not h or w <= 0 or h <= 0:
            warnings.append(f"page {int(n)} without size")
            continue
        pages.setdefault(int(n), {"page": int(n), "width": w, "height": h})
    regions, paragraphs, sections = [], [], []
    for i, r in enumerate(listed(source.get("regions"))):
        n = int(number(first_of(r, "pageNumber", "page")) or 0)
        if n not in pages:
            warnings.append(f"region {i + 1} on no page")
            continue
        kind = re.sub(r"[_\s]+", "-", str(first_of(r, "type", "kind") or "paragraph").strip().lower())
        box = box_of(r, pages[n]["width"], pages[n]["height"])
        if box is None:
            warnings.append(f"region {i + 1} without box")
            continue
        regions.append({"id": str(r.get("id") or f"region_{i + 1}"), "page": n, "kind": _TYPES.get(kind, kind), "text": " ".join(str(first_of(r, "text", "content") or "").split()), "box": box})
    for i, p in enumerate(listed(source.get("paragraphs")) or [r for r in regions if r["kind"] in ("paragraph", "heading")]):
        words = " ".join(str(first_of(p, "text", "sourceText", "content") or "").split())
        if not words:
            warnings.append(f"paragraph {i + 1} without text")
            continue
        paragraphs.append({"ord": len(paragraphs), "page": int(number(first_of(p, "pageNumber", "page")) or 1), "text": words})
    for s in under("sections", "structure"):
        title = " ".join(str(first_of(s, "title", "name") or "").split())
        if not title:
            warnings.append("section without title")
            continue
        a = int(number(first_of(s, "startPage", "pageNumber", "page")) or 1)
        sections.append({"title": title, "start_page": a, "end_page": max(a, int(number(first_of(s, "endPage", "pageEndNumber")) or a))})
    return {"status": "warn" if warnings else "ok", "pages": sorted(pages.values(), key=lambda p: p["page"]), "sections": sections, "regions": regions, "paragraphs": paragraphs, "warnings": warnings}


def _expand(df: DataFrame, keys: list[str], inputs: list[str], added: str, run) -> DataFrame:
    """keys and the columns of `added`, a row for each dictionary that run gives for the inputs of a row."""
    schema = df.select(*keys).schema
    names = [part.split()[0] for part in added.split(",")]
    for part in added.split(","):
        schema = schema.add(*part.split())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in it:
            at, out = [], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in b.columns[len(keys) :]), strict=True)):
                for row in run(*values):
                    at.append(i)
                    out.append(row)
            idx = pa.array(at, pa.int64())
            cols = [pa.array([r.get(n) for r in out], kinds.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(idx) for k in range(len(keys))], *cols], names=schema.names)

    return df.select(*keys, *inputs).mapInArrow(batches, schema)


def model_items(answers: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """answers to (keys, paragraph_id, item: JSON with sorted names), a row for each item."""

    def run(t: str | None):
        for item in items_of(t):
            yield {"paragraph_id": str(v) if (v := first_of(item, "paragraphId", "id")) is not None else None, "item": json.dumps(item, ensure_ascii=False, sort_keys=True, separators=(",", ":"))}

    return _expand(answers, keys, [text], "paragraph_id string, item string", run)


def page_regions(pages: DataFrame, keys: list[str], regions: str = "regions", page: str = "page", width: str = "width", height: str = "height") -> DataFrame:
    """pages (keys, page, width, height, regions: JSON text) to the usable regions, columns of REGION."""

    def run(n: int | None, w: float | None, h: float | None, t: str | None):
        got = model_json(t)
        found = got if isinstance(got, list) else next((got[k] for k in ("regions", "visualRegions", "items") if isinstance(got, dict) and isinstance(got.get(k), list)), [])
        for i, item in enumerate(found):
            if isinstance(item, dict) and (r := region_of(item, int(n or 0), float(w or 0), float(h or 0), i + 1)):
                yield r

    return _expand(pages, keys, [page, width, height, regions], REGION, run)


def layout_paragraphs(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Layout documents to (keys, status, n_regions, ord, page, text, warnings), a row for each paragraph."""

    def run(t: str | None):
        got = layout_of(t)
        for p in got["paragraphs"]:
            yield p | {"status": got["status"], "n_regions": len(got["regions"]), "warnings": "; ".join(got["warnings"])}

    return _expand(documents, keys, [text], "status string, n_regions long, ord long, page long, text string, warnings string", run)
