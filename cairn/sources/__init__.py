"""Readers that turn raw payloads into rows."""
