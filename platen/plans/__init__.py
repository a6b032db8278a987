"""Queries on the driver's tables, each with its SQL where SQL can express it."""

from . import cutting, drawing, judging, measuring, paging, telling, templating, tracking

QUERIES = {**judging.QUERIES, **tracking.QUERIES, **measuring.QUERIES, **templating.QUERIES, **drawing.QUERIES, **telling.QUERIES, **paging.QUERIES, **cutting.QUERIES}
