"""Presence, play-time, rating and history analytics over snapshot streams."""

from rollcall.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
