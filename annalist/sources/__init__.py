"""Reading and writing: message logs, frames, tables, exports."""
