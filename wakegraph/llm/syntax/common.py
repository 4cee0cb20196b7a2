"""What the recognisers share."""


class SyntaxFault(Exception):
    """The text isn't in the language."""
