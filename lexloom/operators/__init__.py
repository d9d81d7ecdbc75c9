"""DataFrame operators over text entries and variable snapshots."""
