"""Registered queries; importing this package registers them all."""

from tideq.plans import changes, ordered, registry, streams  # noqa: F401
