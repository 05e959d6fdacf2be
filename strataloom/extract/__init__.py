"""Structure of source files: imports, calls, symbols, bases and injections, by language."""
