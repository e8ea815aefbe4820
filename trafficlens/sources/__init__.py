"""Sources and sinks: driver tables, stand-ins, files, UI-event logs."""
