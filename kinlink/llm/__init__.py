"""Training-data operators. Nothing outside this subpackage imports it.

Modules are imported one by one (``from kinlink.llm import mixing``), so a
Python worker loads only the operator that it runs.
"""
