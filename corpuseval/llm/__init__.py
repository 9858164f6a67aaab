"""Operators for preparing training text: filtering, de-duplication, scoring, counting and packing.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface; ``queries``
applies them to the given tables.
"""
