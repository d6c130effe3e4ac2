"""Training-data operators: decontamination, scoring, media, packing and de-duplication.

Nothing else in the library imports this subpackage.  Every operator takes a DataFrame with at
least ``doc_id`` (integer) and ``text`` (string), reads those columns only, and so is indifferent
to further columns, whatever their names.
"""
