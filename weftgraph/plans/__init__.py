"""The pattern query language: lexer, parser and compiler to DataFrame plans."""
