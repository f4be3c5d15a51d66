"""Corpora to prompts and model responses to edits, as Spark operators over tables."""

from folioflow.plans import EditResult, build_prompts, edit_files, publish_edits
from folioflow.session import build_session
from folioflow.sources.filestore import FileStore

__all__ = ["EditResult", "FileStore", "build_prompts", "build_session", "edit_files", "publish_edits"]
