"""All registered queries."""

from callglass.plans import audits, browser, dashboard, folding, ingestion, stored, streams, talk, texts

ALL = [
    *dashboard.QUERIES, *browser.QUERIES, *ingestion.QUERIES, *texts.QUERIES, *talk.QUERIES, *folding.QUERIES, *audits.QUERIES,
    *streams.QUERIES, *stored.QUERIES,
]
