"""Training-data pipeline operators (archives, scoring, near duplicates, packing,
decontamination, licences, secrets, language, vector search).

Nothing outside this package imports it.  ``queries`` registers one query per
operator; ``__spark_entry__`` adds them when the package is present.
"""
