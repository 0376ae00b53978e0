"""Training-data operators: licence scan, dedup, PII, toxicity, packing and the like.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_*`` queries that fix the result columns live in
:mod:`siftwell.llm.queries`.
"""
