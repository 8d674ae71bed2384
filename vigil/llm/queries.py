"""All queries of this subpackage."""

from vigil.llm import collocations, conversations, decontaminate, fmindex, jaccard, pack, radix, resample, reshard, templates, topk, toxicity, warc  # noqa: F401
from vigil.llm.registry import ORACLES, QUERIES  # noqa: F401
