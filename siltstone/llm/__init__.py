"""Training-data operators: mixing, quality, packing, media, search, chat, HTML, language and dedup.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames;
``queries`` registers one whole-table query per operator.
"""
