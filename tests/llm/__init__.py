"""Tests of tillworks.llm."""
