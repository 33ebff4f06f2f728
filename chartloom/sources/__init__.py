"""Readers that turn raw snapshots, pages and catalogue documents into tables, and sinks."""
