"""Corpus operators over the text records of a colouring project.

Saved project documents (``project_id``, ``body``), style descriptors (``style_key``,
``description``, ``source``), audited files (``path``, ``text``) and downloaded bodies
(``url``, ``body``) are the records these operators were written for. Nothing outside
this package imports it.
"""
