"""The query slate: every query with its SQL where SQL can express it."""

from . import decisions, detections, documents, evaluation, furniture, interchange, layout, marginalia, marks, middle, notes, numbering, pages, queue, render, review, sources, streams, text, trees

MODULES = (text, numbering, furniture, layout, detections, decisions, marginalia, evaluation, documents, interchange, marks, middle, notes, pages, render, sources, review, trees, queue, streams)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
