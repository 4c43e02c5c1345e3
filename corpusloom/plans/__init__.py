"""Registered queries; importing the modules fills the registry."""

from . import base, files, judging, relational, statistics, texts  # noqa: F401
