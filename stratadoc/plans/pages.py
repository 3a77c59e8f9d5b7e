"""The few pages the engine shows: its catalogue and its usage."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.operators import catalogue_views


def _page(title: str, body: str) -> str:
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def usage_page(days: list[tuple[str, int]], totals: dict[str, int]) -> str:
    """Requests of each day as bars, and the totals."""
    most = max([n for _, n in days], default=0) or 1
    bars = "".join(f'<tr><td>{escape(d)}</td><td><div style="background:#357;height:1em;width:{n * 400 // most}px"></div></td><td>{n}</td></tr>' for d, n in days)
    return _page("Usage", f"<ul>{''.join(f'<li>{escape(k)}: {v}</li>' for k, v in totals.items())}</ul><table>{bars}</table>")


def catalogue_page(files: DataFrame) -> str:
    """The documents by place and agency, in display order; as long as the list of files is."""
    rows = catalogue_views.nested(files).orderBy("position", "jurisdiction", "state", "locality", "agency").select(
        F.concat_ws(" / ", *(F.nullif(F.col(c), F.lit("")) for c in ("jurisdiction", "state", "locality", "agency"))).alias("place"), "documents"
    )
    items = "".join(f"<li>{escape(r.place or '')}<ul>{''.join(f'<li>{escape(d)}</li>' for d in r.documents.split('; '))}</ul></li>" for r in rows.toLocalIterator())
    return _page("Documents", f"<ul>{items}</ul>")
