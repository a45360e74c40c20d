"""Thresholds of the layout rules, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # columns
    bins: int = 200
    gutter: float = 0.03
    density: float = 0.18
    min_column: float = 0.12
    prose_lines: int = 4
    prose_share: float = 0.5
    # furniture, in percent of the page
    stable: float = 3.0
    repeats: int = 3
    tight_top: float = 6.0
    tight_bottom: float = 90.0
    margin_top: float = 15.0
    margin_bottom: float = 85.0
    # banners
    banner_band: float = 15.0
    banner_marker: float = 25.0
    banner_lines: int = 4
    # numbered options and marker columns
    option_indent: float = 9.0
    anchor_number: int = 6
    margin_gap: float = 6.0
    marker_gap: float = 0.12
    marker_count: int = 2
    marker_pad: float = 6.0
    # answer-key grids
    key_cells: int = 4
    key_bucket: float = 4.0
    key_band: float = 1.0
    key_pairs: int = 4
    key_coverage: float = 0.7
    # review
    tiny: float = 4.0
    short: float = 0.45
    tall: float = 1.9
    tall_least: float = 45.0
    page_bottom: float = 92.0
    bottom_most: float = 35.0
    overlap: float = 6.0
    cover_pad: float = 1.5
    tail: float = 8.0
    body_top: float = 6.0
    body_bottom: float = 94.0
    gap: float = 14.0
    head: float = 2.0
    orphan: float = 6.0
    # duplicates
    iou: float = 0.6
    near_segment: float = 3.0
    dedup_y: float = 2.0
    phantom_gap: int = 10
    phantom_below: int = 4
    watermark_edge: float = 0.02
    watermark_pages: int = 3


LIMITS = Limits()
