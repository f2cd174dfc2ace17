"""Schemas of the inputs; every field may be null."""

from __future__ import annotations

POEM = "author string, title string, id string, rhythmic string, paragraphs array<string>"
STRAIN = "strains array<string>, id string"
ENGINES = ("baidu", "so360", "bing", "bing_en", "google")
RANK = "author string, rhythmic string, title string, " + ", ".join(f"{e} bigint" for e in ENGINES)
METRICS = ("train_loss", "train_bpc", "avg_val_loss", "avg_val_bpc")
METRIC_LOG = "step int, " + ", ".join(f"{m} double" for m in METRICS)
CATALOG_ENTRY = "name string, id int, path string, excludes array<string>, tag string, comments string"
PLACE = ("source_file", "rec_pos")
