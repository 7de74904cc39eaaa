"""Errors of the engine."""


class NotFitted(KeyError):
    """An estimator was asked for a result before ``fit``."""


class NoModel(RuntimeError):
    """An operator needs an external model, and none is configured."""
