"""menuflow: a PySpark engine for catalogue observations.

Everything is a function ``DataFrame -> DataFrame`` or ``Column -> Column``; the
plan is declared with the DataFrame API and left to Catalyst. The subpackage
``llm`` is optional: nothing outside it imports it.
"""
