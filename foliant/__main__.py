from foliant.cli import main

main()
