"""Training-data operators: filtering, deduplication, decontamination, scoring and packing.

Nothing outside this subpackage imports it. Each module has one operator with a general interface;
``queries`` derives the digest rows that the registered queries return.
"""
