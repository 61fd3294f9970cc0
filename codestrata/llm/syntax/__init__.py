"""Problem 3: syntax checkers by recursive descent, precedence climbing and panic-mode recovery.

Each language module turns a text into a *kind string*, one character a token, so that every identifier
is the same character. Whether a text is valid depends on that string alone; sub-parses (declarations,
statement blocks, statements) are therefore memoised on it in a bounded table.
"""
