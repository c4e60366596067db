"""Operations of a large training-data pipeline, over research reports and panel rows.

The library's text record is the research report: ``report_id`` and ``report``
(the rendered text).  Operators that have no counterpart among the project's
records (language, chat layouts, test items, personal data) stay general and
say so in their docstring.  Nothing outside this folder imports it.
"""
