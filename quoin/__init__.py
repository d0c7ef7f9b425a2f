"""A PySpark-native engine for grounded text corpora. The names below are loaded when they are first used."""

from importlib import import_module

__version__ = "0.2.0"
_WHERE = {
    "manifest": "sources.library", "registry": "sources.library", "read_sources": "sources.library:sources", "read_cards": "sources.library:cards", "Library": "sources.library", "Catalog": "sources.library", "ConfigError": "sources.library",
    "markers_of": "functions.anchors", "parse_markers": "functions.anchors", "resolve": "functions.anchors", "search": "operators.retrieval:bm25", "consult": "operators.retrieval", "diagnose": "operators.retrieval",
    "evidence_status": "operators.grounding", "evidence_context": "operators.grounding", "context_bundle": "operators.grounding", "occurrence_status": "operators.grounding", "phrase_hits": "operators.grounding", "report": "operators.grounding",
    "check": "operators.linter", "retrieve_evidence": "operators.services", "execute": "operators.services", "SERVICES": "operators.services", "review": "operators.gate", "derive": "operators.gate", "Calibration": "operators.judge", "verify_extractions": "operators.ingestion",
}
__all__ = ["__version__", *_WHERE]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, _, other = _WHERE[name].partition(":")
    return getattr(import_module(f"{__name__}.{module}"), other or name)
