"""Intermediate tables of the corpus operators, in the folder that the whole cluster shares."""

from pixelmill.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
