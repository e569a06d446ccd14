"""Tables, containers and sinks."""
