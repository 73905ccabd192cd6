"""Parsing source files into chunks: Spark plans for line rules, a small lexer where nesting has to be followed."""
