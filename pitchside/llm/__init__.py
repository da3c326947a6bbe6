"""Training-data operators: chat formatting, token counts, near duplicates, fixity audit,
benchmark decontamination, sharding, quality, packing, nearest neighbours, language ID.

Nothing in the rest of the package imports this one. Python code in tasks is
imported by name, so workers need the package (``PYTHONPATH`` or ``--py-files``).
"""
