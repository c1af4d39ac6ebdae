"""Streams.

No operator here keeps state over an unbounded stream: every one is defined over whole tables. The row-wise
ones (``clean.trim``, ``text_case``, ``string_ops``, ``date_features``, ``text.preprocess_text``, ``clean_social``,
``text_counts``, ``is_data_related``, ``timeseries.calendar_features``, ``sqltables.update_where`` and
``delete_where``) are plain projections and filters, so they take a ``readStream`` DataFrame as it is.
"""
