"""Validity of source files: lexer states over chunks, then local grammars over statements."""
