"""Errors of plans and operators."""


class ConfigNotSetError(Exception):
    """A plan is used before it has a config."""


class InvalidConfigError(Exception):
    """A config contradicts itself or the operators."""


class InvalidDataError(Exception):
    """Data don't fit the plan or an operator's bounds."""


class OutOfBoundsError(InvalidDataError):
    """A column has values that an operator's bounds exclude; ``bad`` tells by a column of values whether they are."""

    def __init__(self, message: str, bad=None):
        super().__init__(message)
        self.bad = bad


class NotFittedError(Exception):
    """A plan or operator is applied before it is fitted."""


class TransformerInputError(Exception):
    """An operator's parameters are unusable."""


class TransformerProcessingError(Exception):
    """An operator meets values that it can't process."""
