"""Training-data operators: packing, tokenisation, quality, de-duplication, safety, language, search.

Nothing else in the library imports this subpackage. ``entries`` holds the
queries and ``oracle`` the SQL that the driver's entry file adds when this
subpackage is present.
"""
