"""Jobs: whole tasks with a command line and a settings file, built from the library's operators."""
