"""The registered queries of this subpackage and their comparison SQL."""

from importlib import import_module

MODULES = ["warc", "linefreq", "langid", "doubling", "suffixdedup", "packing", "toxicity", "linededup", "simhash", "decontaminate",
           "merkle", "chat", "ranked"]

QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = import_module(f"tenantlens.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
