"""Schemas of the tables: parts, relationships, media, paragraphs, questions, formulas, job events."""

from __future__ import annotations

PARTS = "file_id string, part_name string, bytes binary"
RELATIONSHIPS = "file_id string, rel_id string, rel_type string, rel_type_raw string, target string"
MEDIA = "file_id string, original_filename string, filename string, kind string, bytes binary"
IMAGE = "struct<type: string, rel_id: string, filename: string, original_filename: string>"
ITEM = f"struct<type: string, text: string, image: {IMAGE}>"
STYLE = "struct<style_id: string, is_heading: boolean, heading_level: int, alignment: string, indent: int>"
PARAGRAPHS = f"file_id string, pos int, style {STYLE}, text string, content_items array<{ITEM}>, has_formula boolean, inline_formula_count int, block_formula_count int, latex_formulas array<string>"
OPTION = "struct<label: string, content: string, content_html: string, is_latex: boolean, images: array<string>>"
QUESTIONS = f"file_id string, id string, ord int, number int, type string, type_name string, content string, content_html string, options array<{OPTION}>, answer string, analysis string, score double, difficulty string, images array<string>, latex_formulas array<string>"
HTML_BLOCKS = "file_id string, pos int, tag string, text string, content_html string, latex_formulas array<string>, images array<string>"
FORMULAS = "file_id string, pos int, type string, latex string, context string, env_name string, image_ref string, image_filename string, hash string, status string, cached boolean"
JOB_EVENTS = "file_id string, ts timestamp, status string, progress int, message string, mode string"
